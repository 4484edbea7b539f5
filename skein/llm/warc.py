"""WARC files: written by Spark's text writer, read back by boundary-chain verification.

A reader sees the record magic wherever it stands, also inside payloads. Tasks read ranges of files; each magic in them is a
candidate with one successor, the place that its own Content-Length leads to. Pointer jumping keeps what is reachable
from the file's start and so rejects magics in payloads: in a task over the candidates of a range, then by joins over the
places at which chains leave ranges, then in each range from the place at which the file's chain enters it. A file whose
chain does not end at its last byte raises an error. A payload that holds magics, over several ranges maybe, is put
together again for its digest alone, in a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, may_be_member, member_bits, saved, spread, whole_groups

#: Bytes of payload that a file holds on average.
TARGET_BYTES = 16 << 20
#: Equal payloads of at least so many bytes are written once.
REVISIT_BYTES = 1000
MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
_FIELD = re.compile(rb"(?m)^([A-Za-z-]+): ?([^\r\n]*)")
_BLANK = re.compile(rb"\r\n\r\n")


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = REVISIT_BYTES, target_bytes: int = TARGET_BYTES) -> None:
    """One record for each row. Of records with equal payloads of revisit_bytes or more, those with the largest key are
    responses and the others revisits of it, without a block.

    Null payloads are empty; rows with a null key are always responses; repeated rows give repeated records; an empty
    table gives a folder without records; other columns are ignored. Payloads cross one shuffle, by key, compressed; the
    groups of equal payloads meet only as digests, first aggregated in each task.
    """
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    digests = rows.select("key", F.sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").alias("size"))
    total = digests.agg(F.sum("size")).first()[0] or 0
    files = max(1, -(-total // target_bytes))
    large = digests.where((F.col("size") >= revisit_bytes) & F.col("key").isNotNull())
    kept = large.groupBy("digest").agg(F.max("key").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = large.join(kept, "digest").where("key < kept").select("key", "digest", "kept").distinct()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            body = pa.array([pack.compress(x.as_buffer()) for x in batch.column("payload")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "url", "digest")), body], ["key", "url", "digest", "body"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out, held = [], 0
            for k, u, d, kept_key, body in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "digest", "kept", "body")), strict=True):
                raw = unpack.decompress(body)
                head = ["WARC/1.1", f"WARC-Type: {'response' if kept_key is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if k is None else k}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(u.split())}", f"WARC-Payload-Digest: sha1:{d}"]
                if kept_key is not None:
                    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{kept_key}>", f"Payload-Length: {len(raw)}"]
                    raw = b""
                out.append(("\r\n".join([*head, f"Content-Length: {len(raw)}"]) + END).encode() + raw)
                held += len(out[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    digested = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    bodies = digested.where("key is not null").mapInArrow(packed, "key long, url string, digest string, body binary")
    joined = bodies.repartition(files, "key").join(revisits.repartition(files, "key"), ["key", "digest"], "left")
    # rows without a key have nothing to be joined with and stay where they are
    unkeyed = digested.where("key is null").mapInArrow(packed, "key long, url string, digest string, body binary").withColumn("kept", F.lit(None).cast("long"))
    joined.select("key", "url", "digest", "kept", "body").unionAll(unkeyed.select("key", "url", "digest", "kept", "body")).mapInArrow(records, "value string").write.option("lineSep", END).text(path)


_HEAD = "page_id long, payload_bytes long, stated string, record_type string, refers_to long"
_PIECE = f"file string, block long, at long, size long, follows long, leaves long, digest string, name binary, {_HEAD}"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics, in its order in each split (file, block). The text source deals out ranges of files."""
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, memoryview]]:
    """(file, block, at, piece); at counts the bytes from the split's first piece on."""
    now, at = None, 0
    for batch in batches:
        for file, block, piece in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("piece"), strict=True):
            if (file, block) != now:
                now, at = (file, block), 0
            data = memoryview(piece.as_buffer())
            yield file, block, at, data
            at += len(data) + len(MAGIC)


def _head(data: memoryview) -> tuple[int, dict[str, str]] | None:
    """Where a record's block begins behind the magic, and its fields; null if this is no head with a length."""
    end = _BLANK.search(data)
    if not end:
        return None
    fields = {k.decode(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(data[: end.end()])}
    return (end.end(), fields) if fields.get("Content-Length", "").isdecimal() else None


def jumped(at: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places at, ascending, with one successor each: the next place's number, or its own where that is none of them,
    and the number of the last place of its chain, by pointer jumping."""
    own = np.arange(len(at))
    place = np.minimum(np.searchsorted(at, follows), max(len(at) - 1, 0))
    step = np.where(at[place] == follows, place, own) if len(at) else own
    last = step
    for _ in range(int(len(at)).bit_length()):  # after round k a pointer leaps over 2^k records
        last = last[last]
    return step, last


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece: as if it were a record, where that record's successor would be, and where the chain from it
    leaves this split (null if it ends inside). A record that is one piece gets the digest of its block."""
    names = [x.split()[0] for x in _PIECE.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def out(rows: list[list]) -> pa.RecordBatch:
        at = np.array([r[2] for r in rows], np.int64)
        follows = np.array([-1 if r[4] is None else r[4] for r in rows], np.int64)
        leaves = follows[jumped(at, follows)[1]]
        end = rows[-1][2] + rows[-1][3] + len(MAGIC)
        for r, x in zip(rows, leaves.tolist(), strict=True):
            r[5] = x if x >= end else None
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows: list[list] = []
    for file, block, at, data in _placed(batches):
        if rows and rows[-1][:2] != [file, block]:
            yield out(rows)
            rows = []
        row = [file, block, at, len(data), None, None, None, xxhash.xxh3_128_digest(data), *[None] * 5]
        if found := _head(data):
            body, fields = found
            size = int(fields["Content-Length"])
            claim = body + size + len(END)
            number = lambda f: int(x) if (x := fields.get(f, "").removeprefix("<urn:page:").removesuffix(">")).isdecimal() else None
            row[4] = at + claim + len(MAGIC)
            if claim == len(data):
                row[6] = hashlib.sha1(data[body : body + size]).hexdigest()
            whole = number("Payload-Length") if "Payload-Length" in fields else size
            row[8:] = [number("WARC-Record-ID"), whole, fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"), fields.get("WARC-Type"), number("WARC-Refers-To")]
        rows.append(row)
    if rows:
        yield out(rows)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of splits, sorted by (file, block, at), with the place base of the split in its file and the piece entry at
    which the file's chain enters it, if it does. Marks the pieces on the chain; a piece inside a record of several pieces
    gets the place of that record, or null where it began in a split before."""
    for table in whole_groups(batches, ("file", "block")):
        at, follows = (np.array(table.column(c).fill_null(-1)) for c in ("at", "follows"))
        base, entry = table.column("base")[0].as_py(), table.column("entry")[0].as_py()
        step, live = jumped(at, follows)[0], np.zeros(len(at), bool)
        begin = len(at) if entry is None else int(np.searchsorted(at, entry))
        live[begin : begin + 1] = True
        jump = step
        for _ in range(int(len(at)).bit_length()):  # after round k the first 2^k records of the chain are live
            live[jump[live]] = True
            jump = jump[jump]
        head = np.maximum.accumulate(np.where(live, np.arange(len(at)), -1))
        many = live & (follows != at + np.array(table.column("size")) + len(MAGIC))
        inside = np.where(head < 0, base + at >= len(MAGIC), many[np.maximum(head, 0)])  # before a file's first magic is nothing
        owner = pa.array(base + at[np.maximum(head, 0)], pa.int64(), mask=head < 0)
        extra = {"top": pa.array(base + at), "behind": pa.array(base + follows), "live": pa.array(live), "inside": pa.array(inside), "owner": owner}
        for name, column in extra.items():
            table = table.append_column(name, column)
        yield from table.drop_columns(["follows", "leaves", "base", "entry"]).combine_chunks().to_batches()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of blocks that hold magics, from their pieces (file, owner, top, piece) in order; one batch is held."""
    now, left, sha, out = None, 0, None, []
    for batch in batches:
        for file, owner, piece in zip(batch.column("file").to_pylist(), batch.column("owner").to_pylist(), batch.column("piece"), strict=True):
            data = memoryview(piece.as_buffer())
            if (file, owner) != now:
                if now:
                    out.append((*now, sha.hexdigest()))
                body, fields = _head(data)
                now, sha, left, data = (file, owner), hashlib.sha1(), int(fields["Content-Length"]), data[body:]
            else:
                sha.update(MAGIC[:left])
                left -= min(left, len(MAGIC))
            sha.update(data[:left])
            left -= min(left, len(data))
    if now:
        out.append((*now, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 3, (pa.string(), pa.int64(), pa.string()), strict=True)], ["file", "owner", "found"])


def _place(name: bytes) -> int:
    """What Spark's xxhash64 of the name is."""
    return int.from_bytes(xxhash.xxh64_digest(name, seed=42), "big", signed=True)


def _located(wanted):
    """The pieces that may be wanted, about 4 MB at a time, by the name of their bytes. How Spark deals out the files this
    time does not matter: what stands between two magics is the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["file", "name", "piece"])

        held, size = [], 0
        for file, _, _, piece in _placed(batches):
            name = xxhash.xxh3_128_digest(piece)
            if may_be_member(wanted.value, np.array([_place(name)]))[0]:
                held.append((file, name, piece))
                size += len(piece)
            if size > 4 << 20:
                yield out()
                held, size = [], 0
        yield out()

    return run


def _entries(pieces: DataFrame) -> DataFrame:
    """(file, block, entry): the pieces at which each file's chain, from its start on, enters its splits. Pointers lead from
    a split's possible entries to where the chain from them leaves it; they are doubled until none can be new."""
    exits = pieces.where("leaves is not null").select("file", F.col("leaves").alias("to")).distinct()
    starts = pieces.where(f"top = {len(MAGIC)}").select("file", F.col("top").alias("to")).distinct()
    wanted = exits.unionAll(starts).distinct().select("file", F.col("to").alias("top"))
    jump = saved(pieces.select("file", "block", "at", "top", F.col("leaves").alias("to")).join(wanted, ["file", "top"]).withColumn("live", F.col("top") == len(MAGIC)), "jumps")
    most = jump.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(max(0, most - 1).bit_length()):
        reached = jump.where("live").select("file", F.col("to").alias("top")).distinct().withColumn("hit", F.lit(True))
        ahead = jump.select("file", F.col("top").alias("to"), F.col("to").alias("beyond"))
        # what has nothing ahead stays where it is: at the file's end, or dead
        after = jump.join(reached, ["file", "top"], "left").join(ahead, ["file", "to"], "left")
        after = saved(after.select("file", "block", "at", "top", F.coalesce("beyond", "to").alias("to"), (F.col("live") | F.coalesce("hit", F.lit(False))).alias("live")), "jumps")
        discard(jump)
        jump = after
    return jump.where("live").select("file", "block", F.col("at").alias("entry"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Of each record: page_id, payload_bytes, payload_digest, record_type and refers_to. The digest of a response is
    computed from its block and must equal the one in its header.

    A file whose chain does not begin at its first byte, or does not end at its last, raises an error; so does a wrong
    digest, once the rows are read. A field that is missing is null. Repeated records repeat; a folder without records gives no
    rows. Files may be of any size: their ranges are read by different tasks.
    """
    size = len(MAGIC)
    pieces = saved(_pieces(spark, path).mapInArrow(_candidates, _PIECE), "pieces")
    splits = pieces.groupBy("file", "block").agg((F.max(F.col("at") + F.col("size")) + size).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = saved(splits.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0))), "splits")
    based = pieces.join(splits.select("file", "block", "base"), ["file", "block"])
    entries = _entries(based.select("file", "block", "at", (F.col("base") + F.col("at")).alias("top"), (F.col("base") + F.col("leaves")).alias("leaves")))
    order = ["file", "block", "at"]
    rows = based.join(entries, ["file", "block"], "left").repartition(spread(pieces), "file", "block").sortWithinPartitions(*order)
    schema = f"file string, block long, at long, size long, digest string, name binary, {_HEAD}, top long, behind long, live boolean, inside boolean, owner long"
    chain = saved(rows.select(*[x.split()[0] for x in _PIECE.split(", ")], "base", "entry").mapInArrow(_chain, schema), "chain")
    records = chain.where("live")
    ends = splits.groupBy("file").agg(F.sum("bytes").alias("total")).join(records.groupBy("file").agg(F.max("behind").alias("reached")), "file", "left")
    for file, total, reached in ends.where(f"coalesce(reached, 0) <> total and total > {size}").limit(1).collect():
        raise ValueError(f"the chain of records ends at {(reached or size) - size} of {total - size} bytes of {file}")
    discard(pieces, splits)
    inside = chain.where("inside")
    if inside.limit(1).count():  # blocks with magics in them: their pieces, and no others, are brought together
        owned = inside.select("file", "name", "top", F.last("owner", ignorenulls=True).over(Window.partitionBy("file").orderBy("top")).alias("owner"))
        wanted = spark.sparkContext.broadcast(member_bits(inside.select(F.xxhash64("name").alias("place"))))
        again = _pieces(spark, path).mapInArrow(_located(wanted), "file string, name binary, piece binary")
        # pieces of equal bytes are one here; the join gives each place its own
        parts = again.dropDuplicates(["file", "name"]).join(owned, ["file", "name"]).select("file", "owner", "top", "piece")
        found = parts.repartition(spread(chain), "file", "owner").sortWithinPartitions("file", "owner", "top").mapInArrow(_digests, "file string, owner long, found string")
        records = records.drop("owner").join(found.withColumnRenamed("owner", "top"), ["file", "top"], "left").withColumn("digest", F.coalesce("found", "digest"))
    wrong = F.raise_error(F.concat(F.lit("the payload at "), (F.col("top") - size).cast("string"), F.lit(" does not have the digest in its header")))
    digest = F.when((F.col("record_type") == "response") & ~F.col("digest").eqNullSafe(F.col("stated")), wrong).otherwise(F.col("stated"))
    return records.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
