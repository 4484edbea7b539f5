"""Exact Jaccard join of word shingles, in size-banded tiles.

1. Tasks count all shingles in a sketch of fixed size. Shingles are ordered by that count, then by hash: any order is
   exact, a rare-first one keeps common passages out of the way. A set is known by 96 bits of digest and its size; equal
   sets are one from the start.
2. Two sets that link share a shingle among their first n - ceil(0.8 n) + 1 in that order. Sets that share such a shingle
   form a tile; shingles with the same sets make one tile.
3. In a tile the sets stand by size, and only pairs whose sizes allow a link are looked at. Bitmaps of at least as many
   bits as a set has shingles, each of which flips one, bound the overlap from above: the bits that differ are at most the
   shingles that do. A tile gives a forest over the pairs that may link. A tile too large for a task's memory is taken
   as connected, as it is when its sets are near copies. The trees over all tiles are groups that no link leaves.
4. The sorted shingles of a group meet once, and overlaps are counted exactly; pairs already joined through others are
   skipped. A large group meets in bands, by size and hash, each with one set of the band before. If that leaves it in
   several parts, the sets outside the largest part meet all bands that their sizes allow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, blocks, column_bytes, discard, distinct, heads, lower_table, member_bits, mix, run_hashes, saved, sift, span_hashes, spread, whole_groups, word_spans
from .components import components

#: Words in a shingle, and the similarity of a link in hundredths.
SHINGLE, LEAST = 5, 80
#: Bits of the shortest bitmap; others are powers of two.
SIGNATURE = 256
#: Bits of a shingle's counter number: the sketch has 4 MB however large the corpus is.
SKETCH_BITS, SLICE_BITS = 20, 14
#: Sets of one shingle in a task; by the sketch, the rows of more frequent ones are dealt over several.
HOT = 1 << 17
#: Rows of tokens, or of tiles, that a task gathers before it works on all but the last token or tile.
TILE_ROWS = 1 << 17
#: Sets in a tile or band, shingles in a band, and shingles whose bitmaps a tile may hold.
BAND, BAND_SHINGLES, TILE_SHINGLES = 2000, 1 << 21, 1 << 27


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Each row's distinct shingles as ascending hashes; of fewer words than a shingle, the whole sequence as one."""
    data = lower_table()[data]
    starts, ends, first = word_spans(data, offsets, WHITE)
    words = span_hashes(data, starts, ends)
    runs = run_hashes(words, SHINGLE)
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= SHINGLE:
            yield distinct(runs[a : b - SHINGLE + 1])
        else:
            yield run_hashes(words[a:b], b - a) if b > a else runs[:0]


def prefix_size(n: int) -> int:
    return n - -(-LEAST * n // 100) + 1 if n else 0


def links(n: np.ndarray | int, m: np.ndarray | int, overlap: np.ndarray | int):
    return 100 * overlap >= LEAST * (n + m - overlap)


def _name(shingles: np.ndarray) -> tuple[int, int]:
    """What a set is known by: 64 bits, and its size above 32 more."""
    with np.errstate(over="ignore"):
        one = mix(shingles).sum(dtype=np.uint64)
        two = mix(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(one), len(shingles) << 32 | int(two >> np.uint64(32))


def _nodes(high: np.ndarray, low: np.ndarray) -> pa.Array:
    """Names as binaries of 16 bytes."""
    raw = np.stack([high, low], 1).astype(">u8").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(high), [None, pa.py_buffer(np.arange(0, 16 * len(high) + 1, 16, dtype=np.int32)), pa.py_buffer(raw)])


def _node(shingles: np.ndarray) -> bytes:
    high, low = _name(shingles)
    return high.to_bytes(8, "big") + low.to_bytes(8, "big")


def _numbers(nodes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(column_bytes(nodes)[0].tobytes(), ">u8").astype(np.uint64).reshape(-1, 2)
    return raw[:, 0], raw[:, 1]


def bitmap(shingles: np.ndarray) -> np.ndarray:
    bits = max(SIGNATURE, 1 << (len(shingles) - 1).bit_length())
    flips = np.bincount((mix(shingles) >> np.uint64(32)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8))


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and the task's counts in slices."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    names = ["doc", "th", "node", "n", "bitmap", "slice", "counts"]
    for rows, data, offsets in blocks(batches, "text"):
        node, n, maps, met = [], [], [], [np.zeros(0, np.uint64)]
        for x in shingle_sets(data, offsets):
            node.append(_node(x) if len(x) else None)
            n.append(len(x))
            maps.append(bitmap(x).tobytes() if len(x) else None)
            met.append(x)
        counts += np.bincount(_counter(np.concatenate(met)), minlength=1 << SKETCH_BITS)
        none = pa.nulls(rows.num_rows, pa.int32()), pa.nulls(rows.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([rows.column("doc"), rows.column("th"), pa.array(node, pa.binary()), pa.array(n, pa.int32()), pa.array(maps, pa.binary()), *none], names)
    parts = counts.reshape(-1, 1 << SLICE_BITS)
    used = np.flatnonzero(parts.any(axis=1))
    none = [pa.nulls(len(used), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())]
    yield pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int32()), pa.array([np.minimum(parts[i], 2**31 - 1).astype("<i4").tobytes() for i in used], pa.binary())], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slice; one sum is held, however many tasks have counted."""
    now, total = None, np.zeros(1 << SLICE_BITS, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.minimum(total, 2**31 - 1).astype("<i4").tobytes()], pa.binary())], ["slice", "counts"])

    for batch in batches:
        for k, cell in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
            if k != now:
                if now is not None:
                    yield out()
                now, total = k, np.zeros(1 << SLICE_BITS, np.int64)
            total += np.frombuffer(cell.as_buffer(), "<i4")
    if now is not None:
        yield out()


def _prefixes(sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, met = sketch.value, set()
        usual = int(np.median(counts))  # what a counter holds of shingles that only share it
        for _, data, offsets in blocks(batches, "text"):
            high, low, prefix = [], [], []
            for x in shingle_sets(data, offsets):
                if len(x) and (name := _name(x)) not in met:  # a copy in the same task says nothing new
                    met.add(name)
                    high.append(name[0])
                    low.append(name[1])
                    prefix.append(x[np.lexsort((x, counts[_counter(x)]))[: prefix_size(len(x))]])
            flat = np.concatenate([np.zeros(0, np.uint64), *prefix])
            own = np.repeat(np.arange(len(prefix)), [len(x) for x in prefix])
            high, low = np.array(high, np.uint64)[own], np.array(low, np.uint64)[own]
            share = np.maximum(counts[_counter(flat)].astype(np.int64) - usual, 0) // HOT + 1
            salt = np.where(share > 1, 1 + (mix(high) % share.astype(np.uint64)).astype(np.int64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))], ["token", "salt", "high", "low"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges with the same components, over small whole numbers."""
    label = np.arange(int(max(a.max(), b.max())) + 1 if len(a) else 0)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if np.array_equal(low, label):
            child = np.flatnonzero(label != np.arange(len(label)))
            return child, label[child]
        label = low


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by token and salt. The sets of each token with two or more become (tile, node, n); those of one
    that is dealt over tasks, or is too large for a tile, become edges between node and the token's own node, other."""
    names = ["tile", "node", "n", "other"]

    def out(token: np.ndarray, salt: np.ndarray, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        by = np.lexsort((low, high, salt, token))
        token, salt, high, low = (x[by] for x in (token, salt, high, low))
        new = heads(token, salt, high, low)
        token, salt, high, low = (x[new] for x in (token, salt, high, low))
        n = (low >> np.uint64(32)).astype(np.int64)
        head = heads(token, salt) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(token)))
        if not len(head):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.int32()), pa.array([], pa.binary())], names)
        wide = np.repeat((salt[head] > 0) | (size > BAND) | (np.add.reduceat(n, head) > TILE_SHINGLES), size)
        with np.errstate(over="ignore"):
            tile = np.repeat(mix(np.add.reduceat(mix(high ^ mix(low)), head) + size.astype(np.uint64)), size).view(np.int64)
        at = np.flatnonzero(~wide & (np.repeat(size, size) > 1))
        at = at[np.lexsort((low[at], high[at], tile[at]))]
        at = at[heads(tile[at], high[at], low[at])] if len(at) else at
        found = [pa.array(tile[at]), _nodes(high[at], low[at]), pa.array(n[at].astype(np.int32)), pa.nulls(len(at), pa.binary())]
        if wide.any():
            every = np.concatenate([np.stack([high[wide], low[wide]], 1), np.stack([token[wide].view(np.uint64), np.full(wide.sum(), 2**64 - 1, np.uint64)], 1)])
            one, number = np.unique(every, axis=0, return_inverse=True)
            a, b = _forest(*number.ravel().reshape(2, -1))
            more = [pa.nulls(len(a), pa.int64()), _nodes(one[a, 0], one[a, 1]), pa.nulls(len(a), pa.int32()), _nodes(one[b, 0], one[b, 1])]
            found = [pa.concat_arrays(x) for x in zip(found, more, strict=True)]
        return pa.RecordBatch.from_arrays(found, names)

    held: list[list[np.ndarray]] = [[np.zeros(0, t) for t in (np.int64, np.int32, np.uint64, np.uint64)]]
    size, due = 0, TILE_ROWS
    for batch in batches:
        held.append([np.array(batch.column("token")), np.array(batch.column("salt")), np.array(batch.column("high")).view(np.uint64), np.array(batch.column("low")).view(np.uint64)])
        size += batch.num_rows
        if size > due:
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            if cut := int(heads(rows[0], rows[1])[-1]):
                yield out(*(x[:cut] for x in rows))
            held, size = [[x[cut:].copy() for x in rows]], size - cut
            due = max(TILE_ROWS, 2 * size)  # the last token may go on for long
    yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))


class _Bitmaps:
    """Bitmaps of sets with n shingles each, in one buffer of words."""

    def __init__(self, n: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        self.n, self.words, self.first, self.width = n, np.frombuffer(data.tobytes(), np.uint64), offsets[:-1] // 8, np.diff(offsets) // 8

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Flags the pairs of rows (i not larger than j) whose bitmaps allow a link. A longer bitmap is folded."""
        out = np.zeros(len(i), bool)
        for w in np.unique(self.width[i]).tolist():
            mine = np.flatnonzero(self.width[i] == w)
            for part in np.split(mine, range(max(1, (1 << 20) // w), len(mine), max(1, (1 << 20) // w))):
                a, b = i[part], j[part]
                place = np.arange(w)
                differ = self.words[self.first[a][:, None] + place]
                for k in range(int((self.width[b] // w).max()) if len(b) else 0):
                    long = np.flatnonzero(self.width[b] > k * w)
                    differ[long] ^= self.words[self.first[b[long]][:, None] + k * w + place]
                count = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
                out[part] = links(self.n[a], self.n[b], (self.n[a] + self.n[b] - count) // 2)
        return out


class _Union:
    """Sets joined so far. root is each one's label as of the last refresh: equal labels are joined, others may be."""

    def __init__(self, size: int) -> None:
        self.parent, self.root, self.old = list(range(size)), np.arange(size), False

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.old = True

    def refresh(self) -> None:
        if self.old:
            root = np.array(self.parent)
            while (root != (up := root[root])).any():
                root = up
            self.root, self.old = root, False

    def stars(self, nodes: pa.Array) -> pa.RecordBatch:
        """Edges from each joined set to the smallest that it is joined with."""
        high, low = _numbers(nodes)
        by = np.lexsort((low, high, self.root))
        head = heads(self.root[by])
        least = np.repeat(by[head], np.diff(np.append(head, len(by))))
        far = by != least
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(by[far])), nodes.take(pa.array(least[far]))], ["a", "b"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile. A forest over the pairs of each tile that sizes and bitmaps allow, of many tiles together:
    in round k every set looks at the k-th after it by size."""
    for table in whole_groups(batches, ("tile",), TILE_ROWS // 4):
        table = table.combine_chunks()
        tile, n = np.array(table.column("tile")), np.array(table.column("n")).astype(np.int64)
        nodes = table.column("node").combine_chunks()
        order = np.lexsort((*_numbers(nodes)[::-1], n, tile))
        tile, n = tile[order], n[order]
        maps = _Bitmaps(n, *column_bytes(table.column("bitmap").take(pa.array(order))))
        union = _Union(len(n))
        live, k = np.arange(len(n)), 1
        while len(live):
            live = live[live + k < len(n)]
            live = live[(tile[live] == tile[live + k]) & (100 * n[live] >= LEAST * n[live + k])]
            i = live[union.root[live] != union.root[live + k]]
            for x in i[maps.may_link(i, i + k)].tolist():
                union.join(x, x + k)
            union.refresh()
            k += 1
        yield union.stars(nodes.take(pa.array(order)))


def _sets(wanted):
    """The sets of documents that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in blocks(sift(batches, wanted), "text"):
            sets = [x for x in shingle_sets(data, offsets) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    return run


_CELL = ("tile", "band", "part")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, band, part, side, node, root, shingles) come sorted by cell, (tile, band, part). In each cell the sets of
    different roots meet: side 0 each other where the cell has that side alone, else side 1 all of side 0. Gives edges between what is joined."""
    for table in whole_groups(batches, _CELL):
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        size, side = np.array([len(x) for x in sets]), np.array(table.column("side"))
        order = np.argsort(size, kind="stable")
        n, side, sets = size[order], side[order], [sets[i] for i in order.tolist()]
        nodes = table.column("node").combine_chunks().take(pa.array(order))
        cross, union = bool(side.any()), _Union(len(n))
        roots: dict = {}
        for i, x in enumerate(table.column("root").take(pa.array(order)).to_pylist()):
            if x is not None:
                union.join(i, roots.setdefault(x, i))
        union.refresh()
        maps = None
        for i in range(len(n) - 1):
            last = int(np.searchsorted(n, 100 * n[i] // LEAST, "right"))
            some = i + 1 + np.flatnonzero(union.root[i + 1 : last] != union.root[i])
            if cross:
                some = some[side[some] != side[i]]
            if len(some) > 4:
                if maps is None:
                    rows = [bitmap(x) for x in sets]
                    maps = _Bitmaps(n, np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])]))
                some = some[maps.may_link(np.full(len(some), i), some)]
            for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(n[some]) >> 20)) + 1) if len(some) else ():  # about 8 MB of shingles at a time
                width, flat = n[part], np.concatenate([sets[j] for j in part.tolist()])
                inside = sets[i][np.minimum(np.searchsorted(sets[i], flat), n[i] - 1)] == flat
                overlap = np.add.reduceat(inside.astype(np.int64), np.cumsum(width) - width)
                for j in part[links(n[i], width, overlap)].tolist():
                    union.join(i, j)
            union.refresh()
        yield union.stars(nodes)


def _meet(cells: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Edges of the cells (tile, band, part, side, node, root)."""
    rows = cells.join(sets, "node").select(*_CELL, "side", "node", "root", "shingles")
    return rows.repartition(parts, *_CELL).sortWithinPartitions(*_CELL).mapInArrow(_joined, "a binary, b binary")


#: A set's size class: sets that link are of one class or of neighbours.
_CLASS = f"cast(floor(ln(n) / {math.log(100 / LEAST)!r}) as int)"


def _banded(groups: DataFrame) -> DataFrame:
    """Groups (tile, node, n, doc) with each set's size class and band: 0 in groups that fit one, else by class and hash."""
    rows = groups.withColumn("class", F.expr(_CLASS))
    classes = rows.groupBy("tile", "class").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    wide = classes.groupBy("tile").agg(F.sum("k").alias("k"), F.sum("s").alias("s")).where((F.col("k") > BAND) | (F.col("s") > BAND_SHINGLES)).select("tile")
    parts = classes.join(wide, "tile", "left_semi").select("tile", "class", F.ceil(F.greatest(F.col("k") / BAND, F.col("s") / BAND_SHINGLES)).alias("parts"))
    band = F.when(F.col("parts").isNotNull(), F.expr("1 + class * (1L << 40) + pmod(xxhash64(node), parts)")).otherwise(F.lit(0).cast("long"))
    return rows.join(parts, ["tile", "class"], "left").withColumn("band", band).drop("parts")


def _open_cells(rows: DataFrame) -> DataFrame:
    """Of groups in bands that are not one part yet: each band with the sets outside the group's largest part, in parts of
    about a band, where their sizes allow a link."""
    count = rows.groupBy("tile", "root").agg(F.count("*").alias("k"))
    major = count.groupBy("tile").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.count("*").alias("roots"), F.sum("k").alias("all"), F.max("k").alias("most")).where("roots > 1")
    open_ = rows.join(major.select("tile", "major", F.ceil((F.col("all") - F.col("most")) / F.lit(BAND)).alias("parts")), "tile")
    minor = open_.where("root <> major").withColumn("part", F.expr("1 + pmod(xxhash64(node, 1), parts)").cast("long"))
    near = minor.select("tile", "part", F.explode(F.expr("sequence(class - 1, class + 1)")).alias("class")).distinct()
    pairs = open_.select("tile", "class", "band").distinct().join(near, ["tile", "class"]).select("tile", "band", "part", "class")
    members = pairs.drop("class").join(open_.select("tile", "band", "node", "root"), ["tile", "band"]).withColumn("side", F.lit(0))
    apart = F.abs(F.col("class") - F.col("own")) <= 1
    sides = pairs.join(minor.select("tile", "part", "node", "root", F.col("class").alias("own")), ["tile", "part"]).where(apart).withColumn("side", F.lit(1))
    columns = [*_CELL, "side", "node", "root"]
    return members.select(columns).unionAll(sides.select(columns))


def link_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """(key, n_shingles, component_id) for each document: the size of its set and the smallest key that links lead to.
    With with_groups, also th (Spark's xxhash64 of the text) and group_id, which is one for all rows that links connect and for
    no others, also where rows with one key have texts that are not linked; it is null for the empty set and a null key.

    A null or empty text has the empty set, links with nothing and is a component of its own. Rows with a null key have
    a null component. Repeated rows repeat; rows with one key and different texts each have their own set and component.
    An empty table gives an empty one; other columns are ignored.
    """
    spark, parts = documents.sparkSession, spread(documents)
    kind = documents.schema[key].dataType
    rows = documents.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    summary = saved(rows.mapInArrow(_summaries, "doc long, th long, node binary, n int, bitmap binary, slice int, counts binary"), "summaries")
    sketch = np.zeros(1 << SKETCH_BITS, np.int32)
    slices = summary.where("slice is not null").select("slice", "counts").repartition(parts, "slice").sortWithinPartitions("slice")
    for number, counts in slices.mapInArrow(_summed, "slice int, counts binary").collect():
        sketch[number << SLICE_BITS : (number + 1) << SLICE_BITS] = np.frombuffer(counts, "<i4")
    shared = spark.sparkContext.broadcast(sketch)
    known = summary.where("slice is null").select("doc", "th", "node", "n")
    named = summary.where("node is not null and doc is not null").groupBy("node")

    tokens = rows.where("doc is not null").mapInArrow(_prefixes(shared), "token long, salt int, high long, low long")
    order = ["token", "salt"]
    tiles = saved(tokens.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(_tiles, "tile long, node binary, n int, other binary"), "tiles")
    # by node, so that what the tile's sets are joined with decides how they are dealt
    once = tiles.where("tile is not null").select("tile", "node", "n").repartition(parts, "node").dropDuplicates(["tile", "node"])
    signed = once.join(named.agg(F.first("bitmap").alias("bitmap")), "node").select("tile", "node", "n", "bitmap")
    able = signed.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(_bounded, "a binary, b binary")
    able = able.unionAll(tiles.where("tile is null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    trees = components(able)

    groups = trees.select("node", F.col("root").alias("tile")).join(named.agg(F.min("doc").alias("doc"), F.first("n").alias("n")), "node")
    groups = saved(_banded(groups), "groups")
    discard(tiles, trees)
    # texts are read again rather than shuffled: a bitmap of the wanted ids leaves out nearly all others, the join the rest.
    # Rows may share an id and not a text, so each set is named by its own text.
    wanted = spark.sparkContext.broadcast(member_bits(groups.select(F.xxhash64("doc").alias("place"))))
    again = rows.where("doc is not null").select(F.xxhash64("doc").alias("place"), "text").mapInArrow(_sets(wanted), "node binary, shingles binary")
    sets = saved(again.join(groups.select("node"), "node", "left_semi").repartition(parts, "node").dropDuplicates(["node"]), "sets")
    own = groups.select("tile", "band", F.lit(0).cast("long").alias("part"), F.lit(0).alias("side"), "node", F.lit(None).cast("binary").alias("root"))
    first = groups.where("band > 0").groupBy("tile", "band").agg(F.max_by("node", F.struct("n", "node")).alias("node"))
    chain = first.withColumn("band", F.lead("band").over(Window.partitionBy("tile").orderBy("band"))).where("band is not null")
    chain = chain.select("tile", "band", F.lit(0).cast("long").alias("part"), F.lit(0).alias("side"), "node", F.lit(None).cast("binary").alias("root"))
    edges = saved(_meet(own.unionAll(chain), sets, parts), "links")
    roots = components(edges)
    banded = groups.where("band > 0")
    if banded.limit(1).count():  # else no group has more than the band that has met already
        now = banded.join(roots, "node", "left").select("tile", "class", "band", "node", F.coalesce("root", "node").alias("root"))
        more = _meet(_open_cells(saved(now, "bands")), sets, parts)
        edges = saved(edges.unionAll(more), "links")
        roots = components(edges)
    discard(sets, groups)
    # by set, then by document: copies of a text meet only the rows of their own set
    size = known.where("node is not null and doc is not null").groupBy("node").agg(F.min("doc").alias("least")).join(roots, "node", "left")
    smallest = size.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    size = size.join(smallest, "root", "left").select("node", F.coalesce("root", "node").alias("group"), F.coalesce("component", "least").alias("component"))
    has_key = F.col("doc").isNotNull()
    found = known.join(size, "node", "left").select("doc", "n", "th", F.when(has_key, F.col("group")).alias("group"), F.when(has_key, F.coalesce("component", "doc")).alias("component"))
    columns = [F.col("doc").cast(kind).alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("component").cast(kind).alias("component_id")]
    return found.select(*columns, *[F.col("th"), F.col("group").alias("group_id")] * with_groups)
