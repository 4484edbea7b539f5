"""Suffix-array removal of repeated passages: every byte that lies in a WINDOW-byte string which also starts earlier.

Earlier is by (document, start). Whether a window is the first of its text depends on its text alone, so windows can be
dealt to shards by content:

1. Each window is assigned to the SEED-byte string in it whose hash is smallest, leftmost first. Equal windows share
   that seed. Consecutive windows with the same seed make a stretch of about 35 windows. Tasks give a row for each stretch,
   without its bytes; equal stretches of a block meet at once, and all but the earliest are removed whole.
2. Stretches are grouped by the seed's hash. A seed that stands alone has no equal window anywhere. Of equal stretches
   all but the earliest are removed whole. What remains are different stretches around one seed.
3. Their bytes are cut out and go to shards by seed. A shard has a suffix array by Larsson-Sadakane refinement, and
   common prefixes by Kasai's rule, run over all stretches side by side. Runs with common prefixes of WINDOW bytes or
   more are equal windows; all but the earliest place are removed.
4. A seed with more than SHARD_STRETCHES different stretches is split over several shards. Each sends the windows that
   are first in it, as digests cut into ranges at their binary-searched bounds; ranges are merged by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, byte_keys, column_bytes, discard, member_bits, mix, saved, sift, sifted, span_hashes, spread

WINDOW, SEED = 100, 32
#: Different stretches around one seed that a shard takes, and digests in a merged range.
SHARD_STRETCHES, RANGE_DIGESTS = 20_000, 500_000
#: Bytes of stretches in a suffix array, unless one seed has more.
SHARD_BYTES = 3 << 20


def seeds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one seed: the hash of the seed, the first window's place, the number of windows."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(data) < WINDOW:
        return none
    with np.errstate(over="ignore"):
        h, m = byte_keys()[data], 1
        while m < SEED:
            h = h[:-m] * np.uint64(pow(0x9E3779B97F4A7C15, m, 1 << 64)) + h[m:]
            m *= 2
        h = mix(h)
    bits = np.uint64(max(21, int(len(data)).bit_length()))
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    span, m = WINDOW - SEED + 1, 1
    while 2 * m <= span:
        low = np.minimum(low[:-m], low[m:])
        m *= 2
    low = np.minimum(low[: len(low) - (span - m)], low[span - m :])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.ones(len(at), bool)
    for end in offsets[1:-1]:
        inside[max(0, end - WINDOW + 1) : end] = False
    first = np.flatnonzero(inside)
    if not len(first):
        return none
    anchor = at[first]
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(first) != 1)]))
    return h[anchor[begin]], first[begin], np.diff(np.append(begin, len(first)))


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals joined where they overlap or touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[new], reach[np.append(new[1:], len(start)) - 1]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["h", "g", "doc", "th", "lo", "n"]
    for rows, data, offsets in blocks(batches, "text"):
        h, place, n = seeds(data, offsets)
        row = np.searchsorted(offsets, place, "right") - 1
        g = span_hashes(data, place, place + n + WINDOW - 1).view(np.int64)
        h = h.view(np.int64)
        doc, th = np.array(rows.column("doc")), np.array(rows.column("th"))
        lo = place - offsets[row]
        order = np.lexsort((lo, th[row], doc[row], g, h))
        same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
        gone = np.zeros(len(h), bool)
        gone[order[1:][same]] = True
        # a repeated row is the same document, not an earlier one
        group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else order
        head = order[np.concatenate([[0], np.flatnonzero(~same) + 1])[group]] if len(order) else order
        equal = (doc[row[order]] == doc[row[head]]) & (th[row[order]] == th[row[head]]) & (lo[order] == lo[head]) if len(order) else gone
        gone[order[equal]] = False
        keep = ~gone
        keep[order[equal & (order != head)]] = False
        yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(g[keep]), pa.array(doc[row[keep]]), pa.array(th[row[keep]]), pa.array(lo[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32))], names)
        if gone.any():
            wide = place[gone] + row[gone]  # a gap between documents, so that runs do not join across them
            start, end = _merged(wide, wide + n[gone] + WINDOW - 1)
            owner = np.searchsorted(offsets + np.arange(len(offsets)), start, "right") - 1
            lo = start - offsets[owner] - owner
            spread_out = mix(start.astype(np.uint64) + np.uint64(len(data))).view(np.int64) ^ doc[owner]
            yield pa.RecordBatch.from_arrays([pa.array(spread_out), pa.nulls(len(lo), pa.int64()), pa.array(doc[owner]), pa.array(th[owner]), pa.array(lo.astype(np.int32)), pa.array((end - start).astype(np.int32))], names)


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of text in the order of their suffixes, which stop at ends[place]; equal suffixes are ordered by place.

    Larsson-Sadakane: order by a first key of 7 bytes; then only the groups that are not single yet are sorted again, by
    the rank of the place h further on, while h doubles.
    """
    size = len(text)
    places = np.arange(size)
    left = ends - places
    padded = np.append(text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64))
    key = np.zeros(size, np.uint64)
    for t in range(7):
        key = key << np.uint64(9) | np.where(left > t, padded[t : size + t], np.uint64(0))
    order = np.argsort(key)
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])[:size]
    rank = np.empty(size, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, places, 0))
    h = 7
    while True:
        bound = np.append(new, True)
        slots = np.flatnonzero(~(bound[:-1] & bound[1:]))
        if not len(slots):
            return order
        mine = order[slots]
        if h >= left.max():
            order[slots] = mine[np.lexsort((mine, rank[mine]))]
            return order
        ahead = np.where(mine + h < ends[mine], rank[np.minimum(mine + h, size - 1)] + 1, 0)
        both = rank[mine].astype(np.uint64) << np.uint64(32) | ahead.astype(np.uint64)
        by = np.argsort(both)
        mine, both = mine[by], both[by]
        order[slots] = mine
        new[slots] = np.concatenate([[True], both[1:] != both[:-1]])
        rank[mine] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each of the first counts[i] places of each stretch, the bytes it has in common with the suffix before it in the
    order, WINDOW at most. Kasai: a place has at least one byte less than the place before it had; the stretches take
    their steps together."""
    size = len(text)
    slot = np.empty(size, np.int64)
    slot[order] = np.arange(size)
    padded = np.append(text, np.zeros(8, np.uint8))
    word = np.ndarray((size + 1,), "<u8", padded.tobytes(), strides=(1,))
    out = np.zeros(size, np.int64)
    h = np.zeros(len(starts), np.int64)
    for j in range(int(counts.max()) if len(counts) else 0):
        lane = np.flatnonzero(counts > j)
        i = starts[lane] + j
        lane, i = lane[slot[i] > 0], i[slot[i] > 0]
        k = order[slot[i] - 1]
        most = np.minimum(np.minimum(ends[i] - i, ends[k] - k), WINDOW)
        length = np.minimum(np.maximum(h[lane] - 1, 0), most)
        h[counts > j] = 0
        live = np.flatnonzero(length < most)
        while len(live):
            at = length[live]
            differ = word[i[live] + at] ^ word[k[live] + at]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
            length[live] = np.minimum(at + same, most[live])
            live = live[(same == 8) & (length[live] < most[live])]
        h[lane] = length
        out[i] = length
    return out


def later_windows(text: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Flags the windows (the first counts[i] places of stretch i) whose bytes stand at a smaller place too. Stretches are
    in the order of their documents and starts."""
    sizes = counts + WINDOW - 1
    ends = np.repeat(starts + sizes, sizes)
    order = suffix_array(text, ends)
    common = common_prefixes(text, order, starts, counts, ends)[order]
    out = np.zeros(len(text), bool)
    if len(order):
        head = np.flatnonzero(common < WINDOW)
        first = np.repeat(np.minimum.reduceat(order, head), np.diff(np.append(head, len(order))))
        out[order] = order != first
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in blocks(batches, "text"):
        lists = rows.column("stretches")
        own = np.repeat(np.arange(rows.num_rows), np.array(lists.value_lengths().fill_null(0)))
        flat = lists.flatten()
        lo, n = np.array(flat.field("lo")), np.array(flat.field("n"))
        begin = offsets[own] + lo
        raw = data.tobytes()
        step = 1 << 14
        for k in range(0, len(own), step):
            part = slice(k, k + step)
            cut = [raw[b : b + m + WINDOW - 1] for b, m in zip(begin[part].tolist(), n[part].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([flat.field("h")[part.start : part.stop], flat.field("salt")[part.start : part.stop], flat.field("parts")[part.start : part.stop], pa.array(np.array(rows.column("doc"))[own[part]]), pa.array(np.array(rows.column("th"))[own[part]]), pa.array(lo[part]), pa.array(n[part]), pa.array(cut, pa.binary())], ["h", "salt", "parts", "doc", "th", "lo", "n", "bytes"])


_FOUND = "doc long, th int, lo int, size int, h long, part int, digests array<long>, docs array<long>, ths array<int>, los array<int>"


def _shard(table: pa.Table) -> pa.RecordBatch:
    """Removed runs of the shard, and for split seeds the windows that are first in it."""
    doc, th, lo, n = (np.array(table.column(c)) for c in ("doc", "th", "lo", "n"))
    by = np.lexsort((lo, th, doc))
    again = (doc[by[1:]] == doc[by[:-1]]) & (th[by[1:]] == th[by[:-1]]) & (lo[by[1:]] == lo[by[:-1]])
    by = by[np.concatenate([[True], ~again])[: len(by)]]  # a repeated row cuts the same stretches again
    table = table.take(pa.array(by))
    doc, th, lo, n = doc[by], th[by], lo[by].astype(np.int64), n[by].astype(np.int64)
    text, offsets = column_bytes(table.column("bytes"))
    later = later_windows(text, offsets[:-1], n)
    own = np.repeat(np.arange(len(doc)), np.diff(offsets))
    at = np.flatnonzero(later)
    new = np.concatenate([[True], (np.diff(at) != 1) | (own[at[1:]] != own[at[:-1]])])[: len(at)]
    head = np.flatnonzero(new)
    first = at[head]
    length = np.diff(np.append(head, len(at))) + WINDOW - 1
    rows = own[first]
    columns = {"doc": doc[rows], "th": th[rows], "lo": (lo[rows] + first - offsets[rows]).astype(np.int32), "size": length.astype(np.int32)}
    more: list[tuple] = []
    parts, h = np.array(table.column("parts")), np.array(table.column("h"))
    for seed in np.unique(h[parts > 1]):
        mine = np.flatnonzero(h == seed)
        place = np.concatenate([np.arange(offsets[i], offsets[i] + n[i]) for i in mine])
        place = place[~later[place]]
        digest = span_hashes(text, place, place + WINDOW)
        place, digest = place[np.argsort(digest)], np.sort(digest)
        ranges = max(1, int(parts[mine[0]]) * SHARD_STRETCHES * 40 // RANGE_DIGESTS)
        bounds = np.searchsorted(digest, np.array([(k << 64) // ranges for k in range(ranges)], np.uint64))
        for r, (a, b) in enumerate(zip(bounds, np.append(bounds[1:], len(digest)), strict=True)):
            if b > a:
                p = place[a:b]
                i = own[p]
                more.append((int(seed), r, digest[a:b].view(np.int64), doc[i], th[i], (lo[i] + p - offsets[i]).astype(np.int32)))
    k, m = len(rows), len(more)
    fixed = [pa.concat_arrays([pa.array(v), pa.nulls(m, pa.array(v).type)]) for v in columns.values()]
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
    extra = [pa.concat_arrays([pa.nulls(k, t), pa.array([x[c] for x in more], t)]) for c, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*fixed, *extra], ["doc", "th", "lo", "size", "h", "part", "digests", "docs", "ths", "los"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by seed and salt; shards are whole groups of them, about SHARD_BYTES together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        h, salt = np.array(batch.column("h")), np.array(batch.column("salt"))
        last = held[-1] if held else batch
        before = (last.column("h")[len(last) - 1].as_py(), last.column("salt")[len(last) - 1].as_py()) if held else (h[0], salt[0]) if len(h) else (0, 0)
        new = np.concatenate([[(h[:1] != before[0]).any() or (salt[:1] != before[1]).any()], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])])[: len(h)]
        _, offsets = column_bytes(batch.column("bytes"))
        at = 0
        for cut in [*np.flatnonzero(new).tolist(), len(h)]:
            if cut < len(h) and size + offsets[cut] - offsets[at] >= SHARD_BYTES and (held or cut > at):
                held.append(batch.slice(at, cut - at))
                yield _shard(pa.Table.from_batches(held))
                held, size, at = [], 0, cut
        if at < len(h):
            held.append(batch.slice(at))
            size += offsets[-1] - offsets[at]
    if held:
        yield _shard(pa.Table.from_batches(held))


def _merge_ranges(pieces: pa.Table) -> pa.Table:
    """One range of a seed's windows over all its shards: each shard's sorted digests are binary-searched in those merged
    so far; of equal ones the earlier place stays."""
    names = ("digests", "docs", "ths", "los")
    best: list[np.ndarray] | None = None
    lost: list[tuple[np.ndarray, ...]] = []
    for row in zip(*(pieces.column(c) for c in names), strict=True):
        d, doc, th, lo = (np.array(x.values) for x in row)
        d = d.view(np.uint64)
        if best is None:
            best = [d, doc, th, lo]
            continue
        at = np.searchsorted(best[0], d)
        known = (at < len(best[0])) & (best[0][np.minimum(at, len(best[0]) - 1)] == d)
        a, own = at[known], np.flatnonzero(known)
        earlier = (doc[own] < best[1][a]) | ((doc[own] == best[1][a]) & ((th[own] < best[2][a]) | ((th[own] == best[2][a]) & (lo[own] < best[3][a]))))
        lost.append((doc[own[~earlier]], th[own[~earlier]], lo[own[~earlier]]))
        swap, i = a[earlier], own[earlier]
        lost.append((best[1][swap], best[2][swap], best[3][swap]))
        best[1][swap], best[2][swap], best[3][swap] = doc[i], th[i], lo[i]
        fresh = ~known
        best = [np.insert(x, at[fresh], y[fresh]) for x, y in zip(best, (d, doc, th, lo), strict=True)]
    doc, th, lo = (np.concatenate([np.zeros(0, t), *(x[c] for x in lost)]) for c, t in enumerate((np.int64, np.int32, np.int32)))
    return pa.table({"doc": doc, "th": th.astype(np.int32), "lo": lo.astype(np.int32), "size": np.full(len(doc), WINDOW, np.int32)})


def _lead(raw: bytes, at: int) -> int:
    """The start of the UTF-8 character that the byte at this place belongs to."""
    while at and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _after(raw: bytes, at: int) -> int:
    """This place, or the next one at which a UTF-8 character starts."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", whole_characters: bool = False) -> DataFrame:
    """The documents with n_bytes, removed (maximal runs of removed bytes, as start and end), n_removed, n_spans and kept
    (the remaining bytes, together). With whole_characters, a character that loses a byte is removed whole, so that kept
    is UTF-8.

    A null text is empty; a text of less than WINDOW bytes has nothing removed. A null key comes first. Rows with equal
    keys and different texts are ordered by a hash of the text; rows equal in both are one document and get the same
    result. An empty table gives an empty one. Columns of the documents with the names of results are replaced.
    """
    names = [c for c in documents.columns if c not in ("n_bytes", "removed", "n_removed", "n_spans", "kept")]
    inner = {c: f"c{i}" for i, c in enumerate(names)}
    rows = documents.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.col(c).alias(a) for c, a in inner.items() if c != text))
    rows = rows.withColumn("th", F.hash("text"))
    marks = rows.select("doc", "th", "text").mapInArrow(_stretches, "h long, g long, doc long, th int, lo int, n int")
    seed, alike = Window.partitionBy("h"), Window.partitionBy("h", "g")
    place = alike.orderBy("doc", "th", "lo")
    found = marks.withColumn("c", F.count("g").over(seed)).where("c > 1 or g is null")
    found = found.withColumns({"rank": F.rank().over(place), "number": F.row_number().over(place)})
    found = found.withColumns({"kinds": F.sum(F.when(F.col("number") == 1, 1).otherwise(0)).over(seed)})
    found = found.select("h", "doc", "th", "lo", "n", F.expr("g is null or rank > 1").alias("gone"), F.expr("CASE WHEN g is null THEN n ELSE n + " + str(WINDOW - 1) + " END").alias("size"), F.expr("g is not null and number = 1 and kinds > 1").alias("open"), "kinds")
    found = saved(found.where("gone or open"), "stretches")
    split = (found.where("open").agg(F.max("kinds")).first()[0] or 0) > SHARD_STRETCHES

    # a text crosses a shuffle only if a bitmap of ids says that something is cut out of it, first for shards, then for good
    n, context = spread(documents), documents.sparkSession.sparkContext
    placed = rows.withColumn("place", F.xxhash64("doc"))
    opened = found.where("open").select("doc", "th", "h", F.ceil(F.col("kinds") / F.lit(SHARD_STRETCHES)).cast("int").alias("parts"), "lo", "n")
    opened = opened.withColumn("salt", F.expr("cast(pmod(xxhash64(doc, th, lo), parts) as int)"))
    lists = opened.groupBy("doc", "th").agg(F.collect_list(F.struct("h", "salt", "parts", "lo", "n")).alias("stretches"))
    # rows equal in key and text cut the same stretches twice
    some = sifted(placed.select("doc", "th", "text", "place"), context.broadcast(member_bits(opened.select(F.xxhash64("doc").alias("place")))))
    cut = some.join(lists, ["doc", "th"]).mapInArrow(_cut, "h long, salt int, parts int, doc long, th int, lo int, n int, bytes binary")
    # both the removed runs and the pieces of split seeds are read from it, so that no suffix array is built twice
    shards = saved(cut.repartition(n, "h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_shards, _FOUND), "shards")
    gone = found.where("gone").select("doc", "th", "lo", "size").unionAll(shards.where("lo is not null").select("doc", "th", "lo", "size"))
    if split:
        pieces = shards.where("h is not null").select("h", "part", "digests", "docs", "ths", "los")
        gone = gone.unionAll(pieces.groupBy("h", "part").applyInArrow(_merge_ranges, "doc long, th int, lo int, size int"))
    lost = saved(gone, "lost")
    discard(found, shards)
    runs = lost.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "size")).alias("runs"))
    touched = context.broadcast(member_bits(lost.select(F.xxhash64("doc").alias("place"))))

    carried = [a for c, a in inner.items() if c != text]

    def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, "text"):
            removed, kept, raw = [], [], data.tobytes()
            lists = part.column("runs")
            cuts = np.concatenate([[0], np.cumsum(np.array(lists.value_lengths().fill_null(0)))])
            flat = lists.flatten()
            lo, size = np.array(flat.field("lo")), np.array(flat.field("size"))
            for i in range(part.num_rows):
                own = raw[offsets[i] : offsets[i + 1]]
                start, end = _merged(lo[cuts[i] : cuts[i + 1]], (lo + size)[cuts[i] : cuts[i + 1]]) if cuts[i + 1] > cuts[i] else (lo[:0], lo[:0])
                if whole_characters and len(start):
                    start, end = _merged(np.array([_lead(own, a) for a in start.tolist()]), np.array([_after(own, b) for b in end.tolist()]))
                spans = list(zip(start.tolist(), end.tolist(), strict=True))
                removed.append([{"start": a, "end": b} for a, b in spans])
                kept.append(b"".join(own[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(own)], strict=True)))
            out = [*(part.column(c) for c in carried), part.column("text"), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, [*carried, "text", "removed", "kept"])

    kinds = [f"{a} {rows.schema[a].dataType.simpleString()}" for a in carried]
    columns = [*carried, "text", "runs"]
    schema = ", ".join([*kinds, "text string", "removed array<struct<start:int,end:int>>", "kept binary"])
    joined = sifted(placed, touched).join(runs, ["doc", "th"], "left").select(columns).mapInArrow(remaining, schema)
    others = placed.withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType)).select(*columns, "place")
    whole = joined.unionAll(others.mapInArrow(lambda batches: remaining(sift(batches, touched, inside=False)), schema))
    return whole.select(
        *(F.col("text" if c == text else a).alias(c) for c, a in inner.items()),
        F.octet_length("text").cast("long").alias("n_bytes"),
        "removed",
        F.expr("aggregate(removed, 0L, (n, x) -> n + x.end - x.start)").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        "kept",
    )
