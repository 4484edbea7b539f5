"""What the operators share: scratch tables, byte blocks from Arrow batches, and 64-bit hashing in numpy."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.scratch import delete, scratch_path

#: Bytes of text that a task turns into numpy arrays at a time; one longer text is a block of its own.
BLOCK_BYTES = 1 << 21


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by saved() that no later step reads."""
    for df in tables:
        if path := getattr(df, "scratch", None):
            delete(df.sparkSession, path)


def spread(df: DataFrame) -> int:
    """Partitions that a wide step of this session deals out to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the row offsets into them; a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about limit bytes of the column: (rows, bytes, offsets)."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def byte_keys() -> np.ndarray:
    """A fixed random 64-bit key for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: Bytes up to which spans are hashed and compared 8 bytes at a time, all spans together; longer ones one by one.
LONG_SPAN = 256
_ODD = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)


def _words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number, zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], equal for equal bytes wherever they stand.

    Every 8 bytes pass the finaliser, so no sums of powers stand behind it that texts of a regular build could cancel.
    Different spans of equal length up to 8 never meet; others do by chance. Who needs certainty compares with equal_spans.
    """
    size, words = ends - starts, _words_at(data)
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(live):
        left, word = size[live] - at, words[starts[live] + at]
        short = np.flatnonzero(left < 8)
        word[short] &= _MASKS[left[short]]
        with np.errstate(over="ignore"):
            out[live] = mix((out[live] ^ word) * _ODD)
        live, at = live[left > 8], at + 8
    if len(long := np.flatnonzero(size > LONG_SPAN)):
        view = memoryview(np.ascontiguousarray(data))
        out[long] = [int.from_bytes(hashlib.blake2b(view[a:b], digest_size=8).digest(), "little") for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def equal_spans(data: np.ndarray, starts: np.ndarray, other: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Flags the places where data[start : start + size] and other[begin : begin + size] are the same bytes."""
    same, ours = np.ones(len(sizes), bool), _words_at(data)
    theirs = ours if other is data else _words_at(other)
    live, at = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN)), 0
    while len(live):
        left = sizes[live] - at
        differ = ours[starts[live] + at] ^ theirs[begins[live] + at]
        short = np.flatnonzero(left < 8)
        differ[short] &= _MASKS[left[short]]
        same[live] = differ == 0
        live, at = live[(left > 8) & (differ == 0)], at + 8
    for i in np.flatnonzero(sizes > LONG_SPAN).tolist():
        same[i] = np.array_equal(data[starts[i] : starts[i] + sizes[i]], other[begins[i] : begins[i] + sizes[i]])
    return same


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't separators, and each row's first run (rows + 1 long)."""
    word = ~separators[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set for the byte ranges, ends included."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: White space of the contracts' words: space and \t to \r.
WHITE = byte_set((0x20, 0x20), (0x09, 0x0D))


@functools.cache
def lower_table() -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes from each place where n follow: each place in the run has its own odd factor."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    factors = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        total = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            total += words[k : len(words) - n + 1 + k] * factors[k]
        return mix(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """The values, ascending and once each."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


#: Bits of a set of keys that tasks are given to leave out most rows early: 4 MB, whatever the number of keys.
MEMBER_BITS = 25


def member_bits(places: DataFrame) -> np.ndarray:
    """A bitmap of MEMBER_BITS over a column of 64-bit hashes, put together by tasks. What it says is missing is not there;
    with more keys it says so more rarely."""
    place = F.col(places.columns[0])
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({places.columns[0]}, {64 - MEMBER_BITS}) & 63 as int))")
    words = places.select(F.shiftrightunsigned(place, 64 - MEMBER_BITS + 6).cast("int").alias("word"), bit.alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << MEMBER_BITS - 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def sift(batches: Iterator[pa.RecordBatch], wanted: Broadcast, inside: bool = True) -> Iterator[pa.RecordBatch]:
    """The rows whose hash in the column place the bitmap holds; or those that it does not hold. With far more keys than
    bits all rows are taken for inside, which costs time alone."""
    for batch in batches:
        yield batch.filter(pa.array(may_be_member(wanted.value, np.array(batch.column("place"))) == inside))


def sifted(rows: DataFrame, wanted: Broadcast) -> DataFrame:
    """The rows inside, for a shuffle. Steps that go on in Python call sift themselves, as each mapInArrow of a stage has a
    process of its own."""
    return rows.mapInArrow(lambda batches: sift(batches, wanted), rows.schema)


def member_state(place: Column, first: Broadcast, second: Broadcast) -> Column:
    """0 for a hash that the first bitmap does not hold, 1 for one that it holds and the second does not, 2 for the rest.
    Only the hash goes through Python; the row's other columns stay where they are."""

    def state(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            some = hashes.to_numpy()
            held = may_be_member(first.value, some)
            yield pd.Series(held.astype(np.int32) + (held & may_be_member(second.value, some)))

    return F.pandas_udf(state, "int")(place)


def may_be_member(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Flags those xxhash64 hashes (as longs) that the bitmap holds."""
    place = hashes.view(np.uint64) >> np.uint64(64 - MEMBER_BITS)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; also the first."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by the keys: one group each, or several with together so many rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.array(batch.column(k)) for k in keys]
        cuts = heads(*columns)[1:].tolist()
        if held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != c[0] for k, c in zip(keys, columns, strict=True)):
            cuts = [0, *cuts]
        at = 0
        for cut in cuts:
            if count + cut - at >= rows:
                yield pa.Table.from_batches([*held, batch.slice(at, cut - at)])
                held, count, at = [], 0, cut
        held.append(batch.slice(at))
        count += batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)
