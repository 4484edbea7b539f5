"""Benchmark decontamination: a prefix-filtered set join of documents against benchmark windows.

An item's windows are its runs of WINDOW words (an item of fewer words is one window). A window occurs in a document
only if all its word shingles do, so its rarest shingle alone is the prefix that must be joined. Shingles are ordered
by their count over the whole corpus. A match of a prefix fixes where the window would start; length and position
bounds drop those that would leave the document, and the rest are compared word by word over the window: first the words'
hashes, then their bytes.

The benchmark is a stated query set: its different items are taken in blocks of about BLOCK_ITEM_BYTES, each scanned
against all documents, so what a task holds is bounded by that and one item whatever the benchmark's size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.scan import Running, running

from .common import blocks, byte_set, equal_spans, lower_table, run_hashes, span_hashes, word_spans

WINDOW = 10
#: Words in a shingle; a shorter window has one shingle, all of it.
SHINGLE = 3
#: Bytes of benchmark text in a block, which bounds what is broadcast.
BLOCK_ITEM_BYTES = 4 << 20
#: All ASCII but letters and digits separates words.
_SEPARATORS = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


class Words:
    """The lower-cased words of texts: hashes, places, and each text's first word (texts + 1 long)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = lower_table()[data]
        self.starts, ends, self.first = word_spans(self.data, offsets, _SEPARATORS)
        self.sizes = ends - self.starts
        self.hashes = span_hashes(self.data, self.starts, ends)

    def same(self, mine: np.ndarray, other: Words, theirs: np.ndarray) -> np.ndarray:
        """Flags the pairs of a word here and a word there that are the same bytes."""
        out = (self.hashes[mine] == other.hashes[theirs]) & (self.sizes[mine] == other.sizes[theirs])
        some = np.flatnonzero(out)
        out[some] = equal_spans(self.data, self.starts[mine[some]], other.data, other.starts[theirs[some]], self.sizes[mine[some]])
        return out


@dataclass
class Index:
    """The windows of a block of items and, once choose() is called, the shingle by which each is looked up."""

    items: list[str]
    words: Words
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray
    sizes: list[int]
    hashes: np.ndarray
    window: np.ndarray | None = None
    shift: np.ndarray | None = None
    first: np.ndarray | None = None

    @classmethod
    def of(cls, items: list[tuple[str, str]]) -> Index:
        raw = [t.encode() for _, t in items]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        words = Words(data, offsets)
        first, n = words.first, np.diff(words.first)
        starts, lengths, owner = [], [], []
        for i in range(len(items)):
            count = max(1, int(n[i]) - WINDOW + 1) if n[i] else 0
            starts.append(first[i] + np.arange(count))
            lengths.append(np.full(count, min(WINDOW, n[i])))
            owner.append(np.full(count, i))
        start, length, item = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (starts, lengths, owner))
        out = cls([i for i, _ in items], words, start, length, item, sorted({min(SHINGLE, int(x)) for x in length}), np.zeros(0, np.uint64))
        out.hashes = np.unique(np.concatenate([out.hashes, *(out._shingles(s)[0].ravel() for s in out.sizes)]))
        return out

    def _shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of the windows that use this size, by place in the window; those windows."""
        mine = np.flatnonzero(np.minimum(self.length, SHINGLE) == size)
        runs = run_hashes(self.words.hashes, size)
        steps = np.arange(WINDOW - size + 1)
        place = np.minimum(steps, self.length[mine, None] - size)  # the last one again where a window is short
        return runs[self.start[mine, None] + place], mine

    def choose(self, counts: np.ndarray) -> None:
        """Look each window up by its rarest shingle; ties go to the smaller hash."""
        order = np.empty(len(counts), np.int64)
        order[np.lexsort((self.hashes, counts))] = np.arange(len(counts))
        prefix, shift = np.zeros(len(self.start), np.uint64), np.zeros(len(self.start), np.int64)
        for size in self.sizes:
            found, mine = self._shingles(size)
            best = order[np.searchsorted(self.hashes, found)].argmin(axis=1)
            prefix[mine] = found[np.arange(len(mine)), best]
            shift[mine] = np.minimum(best, self.length[mine] - size)
        by = np.argsort(prefix, kind="stable")
        self.hashes, at = np.unique(prefix[by], return_index=True)
        self.window, self.shift, self.first = by, shift[by], np.append(at, len(by))

    @functools.cached_property
    def _filter(self) -> np.ndarray:
        bits = np.zeros(1 << 20, bool)
        bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        return bits

    def seen(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in the rows' words with a known shingle, and its number."""
        first = words.first
        for size in self.sizes:
            runs = run_hashes(words.hashes, size)
            at = np.flatnonzero(self._filter[(runs >> np.uint64(44)).astype(np.int64)])
            number = np.minimum(np.searchsorted(self.hashes, runs[at]), len(self.hashes) - 1)
            at, number = at[(same := self.hashes[number] == runs[at])], number[same]
            row = np.searchsorted(first, at, "right") - 1
            inside = at + size <= first[row + 1]
            yield at[inside], number[inside]

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Where windows occur, whole: the place in the rows' words and the window."""
        out, first = [(np.zeros(0, np.int64),) * 2], words.first
        for at, number in self.seen(words):
            count = self.first[number + 1] - self.first[number]
            entry = np.repeat(self.first[number] - np.cumsum(count) + count, count) + np.arange(count.sum())
            window, place = self.window[entry], np.repeat(at, count)
            begin = place - self.shift[entry]
            row = np.searchsorted(first, place, "right") - 1
            fits = (begin >= first[row]) & (begin + self.length[window] <= first[row + 1])
            begin, window = begin[fits], window[fits]
            same = np.ones(len(begin), bool)
            for k in range(WINDOW):
                there = np.flatnonzero(same & (k < self.length[window]))
                same[there] = words.same(begin[there] + k, self.words, self.start[window[there]] + k)
            out.append((begin[same], window[same]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocks_of(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """The different items in order, cut where another BLOCK_ITEM_BYTES of text have come: a block has less than that and
    its last item. Where each item stands is a scan over slices of the items, whatever their number."""
    items = benchmark.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null").distinct()
    placed = running(items.withColumn("bytes", F.octet_length("text").cast("long")), [], ["item", "text"], {"end": Running("sum", "bytes")})
    dealt = placed.select("item", "text", F.floor((F.col("end") - F.col("bytes")) / BLOCK_ITEM_BYTES).alias("block"))
    for (k,) in dealt.select("block").distinct().orderBy("block").collect():  # a number for each 4 MB
        yield [tuple(r) for r in dealt.where(F.col("block") == k).select("item", "text").collect()]


def decontaminate(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per document: n_words, n_hit (words inside an occurrence of a window), n_items, items (their ids as strings,
    sorted), hits (runs of hit words as start and end, in words) and contaminated; also the columns named in carry.

    A null or empty text has no words; items with a null id or text take no part; an empty benchmark hits nothing. Each
    row is judged by itself, so repeated rows repeat. A carried column with the name of a result gives way to it.
    Documents are never shuffled; the counts that order the shingles cover all of them.
    """
    carried = {c: f"c{i}" for i, c in enumerate(c for c in carry if c not in (key, "n_words", "n_hit", "n_items", "items", "hits", "contaminated"))}
    kind = documents.schema[key].dataType.simpleString()
    more = "".join(f", {a} {documents.schema[c].dataType.simpleString()}" for c, a in carried.items())
    schema = f"id {kind}, text string, n_words long, hits array<struct<start:int,end:int>>, items array<string>{more}"
    out = documents.select(F.col(key).alias("id"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"), *(F.col(c).alias(a) for c, a in carried.items()))
    for items in _blocks_of(benchmark, item_key, item_text):
        index = Index.of(items)
        if len(index.hashes):
            found = documents.select(F.col(text).alias("text")).mapInArrow(_counter(index), "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).collect()
            counts = np.zeros(len(index.hashes), np.int64)
            for number, n in found:
                counts[number] = n
            index.choose(counts)
        out = out.mapInArrow(_marker(index), schema)
    return out.select(
        F.col("id").alias(key),
        "n_words",
        F.expr("aggregate(hits, 0L, (n, x) -> n + x.end - x.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "hits",
        (F.size("hits") > 0).alias("contaminated"),
        *(F.col(a).alias(c) for c, a in carried.items()),
    )


def _counter(index: Index):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.hashes), np.int64)
        for _, data, offsets in blocks(batches, "text"):
            for _, number in index.seen(Words(data, offsets)):
                total += np.bincount(number, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["number", "n"])

    return count


def _marker(index: Index):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(index.items, object)
        for rows, data, offsets in blocks(batches, "text"):
            words = Words(data, offsets)
            first = words.first
            begin, window = index.matches(words) if len(index.hashes) else (np.zeros(0, np.int64),) * 2
            step = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(step, begin, 1)
            np.add.at(step, begin + index.length[window], -1)
            hits, items = rows.column("hits"), rows.column("items")
            touched = np.searchsorted(first, begin, "right") - 1
            if len(begin):
                hits, items = hits.to_pylist(), items.to_pylist()
                depth = np.cumsum(step) > 0
                for row in np.unique(touched):
                    a, b = first[row], first[row + 1]
                    on = depth[a:b].copy()
                    for x in hits[row]:
                        on[x["start"] : x["end"]] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
                    hits[row] = [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)]
                    items[row] = sorted({*items[row], *names[index.item[window[touched == row]]]})
                hits, items = pa.array(hits, rows.schema.field("hits").type), pa.array(items, pa.list_(pa.string()))
            carried = [c for c in rows.schema.names if c not in ("id", "text", "n_words", "hits", "items")]
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("text"), pa.array(np.diff(first)), hits, items, *map(rows.column, carried)], ["id", "text", "n_words", "hits", "items", *carried])

    return mark
