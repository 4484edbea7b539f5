"""SimHash near-duplicates, found by meeting in the middle of Hamming balls.

Two fingerprints that differ in at most RADIUS = 3 bits have a value between them that one reaches by flipping one bit and
the other by at most two. Every fingerprint emits the values around it that may be such meeting points: itself, the 64
values at one flip and, if its own number of set bits is even, also pairs of flips. Fingerprints that differ in three bits
are of different parity, so one of them emits pairs; and of three places at least two lie in the same half of the word, so
pairs within halves are enough (992 in place of 2,016). Equal values meet in one shuffle, as arrays: each task packs what
it emits for a shard (8 bytes of value and 2 for the flip, by which the fingerprint is known) into one cell.

Where a value was reached by one with at most one flip, all others that reached it are within three bits of that one: it
gives a star of links, each verified by counting bits, and no pairs of a group are listed. Two that both flipped two bits
differ in two, and meet elsewhere with one flip each, or in four, and are not linked. So the components of the stars are those
of all links. Equal fingerprints are one from the start.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, blocks, discard, heads, lower_table, mix, saved, spread, whole_groups, word_spans
from .components import components

#: Words in a shingle, the seed of their XXH64, and bits that linked fingerprints may differ in.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints that a task expands together, and values that a shard holds on average.
EXPANDED, SHARD_VALUES = 1 << 12, 1 << 21


@functools.cache
def _lanes() -> np.ndarray:
    """For each byte its eight bits as the bytes of a number, so that sums of up to 255 of them stay apart."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each row: a bit is set if more than half of the row's shingle hashes have it."""
    data = lower_table()[data]
    starts, ends, first = word_spans(data, offsets, WHITE)
    # the words again, each with one space behind it: a shingle is then one span
    size = ends - starts + 1
    end = np.cumsum(size)
    begin = end - size
    joined = np.full(end[-1] if len(end) else 0, 0x20, np.uint8)
    word = ~WHITE[data]
    inside = np.ones(len(joined), bool)
    inside[end - 1] = False
    joined[inside] = data[word]
    count = np.diff(first)
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    total = np.cumsum(n)
    start = np.repeat(first[:-1] - total + n, n) + np.arange(total[-1] if len(total) else 0)
    last = np.minimum(start + SHINGLE, np.repeat(first[1:], n)) - 1
    raw, one = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([one(raw[a:b], SEED) for a, b in zip(begin[start].tolist(), (end[last] - 1).tolist(), strict=True)], np.uint64)
    lanes = _lanes()[hashes.view(np.uint8).reshape(-1, 8)]
    at = total - n  # of each row's first shingle; sums run over at most 255 of one row
    cuts = np.unique(np.concatenate([at[n > 0], *(at[n > k] + k for k in range(255, int(n.max()) if len(n) else 0, 255))]))
    out = np.zeros(len(n), np.uint64)
    if len(cuts):
        sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(-1, 64)
        some = np.flatnonzero(n)
        bits = np.add.reduceat(sums, np.searchsorted(cuts, at[some]), axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * bits > n[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


@functools.cache
def flips() -> np.ndarray:
    """What is flipped on the way to each value around a fingerprint: nothing, one bit, and two bits of one half."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    low, high = np.triu_indices(32, 1)
    pairs = [one[low + half] | one[high + half] for half in (0, 32)]
    return np.concatenate([[np.uint64(0)], one, *pairs]).astype(np.uint64)


def _single() -> int:
    """Of flips(), how many flip one bit at most."""
    return 65


def _unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of common.mix."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
        x *= np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
        x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
        x *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
        return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _shard_of(values: np.ndarray, shards: int) -> np.ndarray:
    """By the upper 32 bits of the mixed values."""
    return ((values >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _emitted(shards: int):
    """Cells (shard, values, flips) of the values around each fingerprint, mixed, so that shards are even."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = flips()
        for batch in batches:
            own = np.array(batch.column("fingerprint")).view(np.uint64)
            for at in range(0, len(own), EXPANDED):
                some = own[at : at + EXPANDED]
                even = np.bitwise_count(some) % 2 == 0
                values, kinds = [], []
                for x, masks in ((some[~even], every[: _single()]), (some[even], every)):
                    values.append((x[:, None] ^ masks).ravel())
                    kinds.append(np.tile(np.arange(len(masks), dtype=np.uint16), len(x)))
                value, kind = mix(np.concatenate(values)), np.concatenate(kinds)
                shard = _shard_of(value, shards)
                by = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
                shard, value, kind = shard[by], value[by], kind[by]
                head = heads(shard)
                cell = lambda x, width: pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer((width * np.append(head, len(shard))).astype(np.int32)), pa.py_buffer(x)])
                yield pa.RecordBatch.from_arrays([pa.array(shard[head]), cell(value, 8), cell(kind, 2)], ["shard", "values", "flips"])

    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard. Verified links (a, b) between fingerprints whose balls meet, each once a shard."""
    every = flips()
    for table in whole_groups(batches, ("shard",)):
        value = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in table.column("values")), np.uint64)
        kind = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in table.column("flips")), np.uint16)
        by = np.argsort(value)
        value, kind = value[by], kind[by]
        head = heads(value)
        size = np.diff(np.append(head, len(value)))
        some = np.repeat(size > 1, size)
        value, kind, size = value[some], kind[some], size[size > 1]
        if not len(value):
            continue
        head = np.cumsum(size) - size
        group = np.repeat(np.arange(len(size)), size)
        own = _unmixed(value) ^ every[kind]
        # of each value: the one that came nearest, of those the smallest
        far = (kind >= _single()).astype(np.int8)
        by = np.lexsort((own, far, group))
        own, far = own[by], far[by]
        centre = np.repeat(own[head], size)
        meets = (np.repeat(far[head], size) == 0) & (own != centre)
        a, b = np.maximum(own, centre)[meets], np.minimum(own, centre)[meets]
        fits = np.bitwise_count(a ^ b) <= RADIUS
        pairs = np.unique(np.stack([a[fits], b[fits]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["a", "b"])


def near_fingerprints(rows: DataFrame, column: str = "fingerprint") -> DataFrame:
    """(node, root) of the fingerprints (longs) that links lead from: root is the smallest node of its component. Repeated
    and null fingerprints do no harm; those without a link give no rows."""
    own = saved(rows.select(F.col(column).alias("fingerprint")).where("fingerprint is not null").distinct(), "fingerprints")
    values = own.count() * (len(flips()) + _single()) // 2
    shards, parts = max(1, -(-values // SHARD_VALUES)), spread(rows)
    cells = own.repartition(parts).mapInArrow(_emitted(shards), "shard long, values binary, flips binary")
    links = cells.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_linked, "a long, b long")
    out = components(links)
    discard(own)
    return out


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in blocks(batches, "text"):
        yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(fingerprints(data, offsets).view(np.int64))], ["id", "fingerprint"])


def link_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id) for each document: component_id is the smallest key that links lead
    to, its own included.

    A null or empty text, or one without words, has fingerprint zero, which is linked like any other. Rows with a null key
    link nothing and have a null component. Repeated rows repeat; rows with one key and different texts each have their own
    fingerprint and component. An empty table gives an empty one; other columns are ignored. Texts are never shuffled.
    """
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("id"), F.col(text).alias("text"))
    own = saved(rows.mapInArrow(_fingerprinted, f"id {kind}, fingerprint long"), "simhash")
    keyed = own.where("id is not null")
    roots = near_fingerprints(keyed)
    # per fingerprint, then per component: copies are aggregated before they are shuffled
    least = keyed.groupBy("fingerprint").agg(F.min("id").alias("least")).join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    least = least.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least")
    component = least.join(least.groupBy("root").agg(F.min("least").alias("component")), "root").select("fingerprint", "component")
    found = own.join(component, "fingerprint", "left")
    return found.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))
