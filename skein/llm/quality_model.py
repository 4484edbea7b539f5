"""Quality classifier: histogram gradient-boosted trees over document statistics.

Tasks turn whole texts into statistics; trees are grown on the driver from the statistics of a bounded sample of labelled
texts, with features cut into BINS bins; the finished trees lie in flat arrays, which a numpy loop over levels walks for
all rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, blocks, byte_set, lower_table, span_hashes, word_spans
from .toxicity import sample_labelled

#: Labelled texts of each class in the sample.
SAMPLE_A_CLASS = 10_000
BINS, DEPTH, TREES, RATE, RIDGE, LEAST_WEIGHT = 48, 4, 80, 0.15, 1.0, 8.0

STATISTICS = (
    "bytes", "words", "lines", "word_bytes", "long_words", "upper", "digit", "punctuation", "symbol", "other_ascii", "high_byte", "white",
    "distinct_words", "same_as_last", "pair_repeats", "repeated_lines", "top_word", "capital_words", "marked_words", "entropy", "words_a_line",
)

_UPPER, _DIGIT, _SYMBOL = byte_set((65, 90)), byte_set((48, 57)), np.isin(np.arange(256), list(b"#*$%&|<>"))
_PUNCTUATION = np.isin(np.arange(256), list(b".,;:!?'\"()-"))
_HIGH = byte_set((128, 255))
_LETTER = byte_set((65, 90), (97, 122), (128, 255))
_OTHER = byte_set((33, 127)) & ~(_LETTER | _DIGIT | _SYMBOL | _PUNCTUATION)
_NEWLINE = ~byte_set((10, 10))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; shares of nothing are 0."""
    rows = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets, WHITE)
    words = span_hashes(lower_table()[data], starts, ends)
    line_starts, line_ends, line_first = word_spans(data, offsets, ~_NEWLINE)
    lines = span_hashes(data, line_starts, line_ends)
    size, n, n_lines = np.diff(offsets).astype(float), np.diff(first).astype(float), np.diff(line_first).astype(float)
    row = np.repeat(np.arange(rows), np.diff(first))
    length = (ends - starts).astype(float)
    out = np.zeros((rows, len(STATISTICS)))
    a, w, k = np.maximum(size, 1), np.maximum(n, 1), np.maximum(n_lines, 1)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    capital = _UPPER[data[starts]] & _UPPER[data[np.minimum(starts + 1, np.maximum(len(data) - 1, 0))]] if len(starts) else same
    marked = ~_LETTER[data[ends - 1]] & ~_DIGIT[data[ends - 1]] if len(ends) else same
    by_row = lambda flags: np.bincount(row, flags, rows)
    columns = [
        np.log1p(size), np.log1p(n), np.log1p(n_lines), by_row(length) / w, by_row(length > 12) / w,
        *(_sums(t[data], offsets) / a for t in (_UPPER, _DIGIT, _PUNCTUATION, _SYMBOL, _OTHER, _HIGH, WHITE)),
    ]
    out[:, : len(columns)] = np.stack(columns, 1)
    for i in range(rows):
        mine = words[first[i] : first[i + 1]]
        if len(mine):
            _, count = np.unique(mine, return_counts=True)
            with np.errstate(over="ignore"):
                pairs = np.sort(mine[:-1] * np.uint64(0x9E3779B97F4A7C15) + mine[1:])
            p = count / len(mine)
            out[i, 12], out[i, 16], out[i, 19] = len(count) / len(mine), p.max(), -(p * np.log(p)).sum()
            out[i, 14] = (pairs[1:] == pairs[:-1]).sum() / len(mine)
        some = lines[line_first[i] : line_first[i + 1]]
        out[i, 15] = 1 - len(np.unique(some)) / len(some) if len(some) else 0
    out[:, 13], out[:, 17], out[:, 18], out[:, 20] = by_row(same) / w, by_row(capital) / w, by_row(marked) / w, n / k
    return out


@dataclass
class Trees:
    """Flat trees: node t of all trees sends a row left if its statistic feature[t] is at most cut[t]; leaves point at
    themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.tile(self.roots, (len(x), 1))
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-np.clip(self.bias + self.value[node].sum(axis=1), -500, 500)))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Boost the logistic loss. Split gains come from sums of gradients and curvatures in each bin; ties go to the first
    feature and bin."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(1) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    share = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    total = np.full(len(x), bias)
    flat = bins + np.arange(x.shape[1]) * BINS

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> int:
        me = len(feature)
        for store, start in ((feature, 0), (cut, np.inf), (left, me), (right, me), (value, -RATE * g[rows].sum() / (h[rows].sum() + RIDGE))):
            store.append(start)
        if depth == DEPTH or h[rows].sum() * 4 < 2 * LEAST_WEIGHT:
            return me
        place = flat[rows].ravel()
        gs = np.bincount(place, np.repeat(g[rows], x.shape[1]), x.shape[1] * BINS).reshape(-1, BINS).cumsum(axis=1)
        hs = np.bincount(place, np.repeat(h[rows], x.shape[1]), x.shape[1] * BINS).reshape(-1, BINS).cumsum(axis=1)
        ns = np.bincount(place, minlength=x.shape[1] * BINS).reshape(-1, BINS).cumsum(axis=1)
        g_all, h_all = gs[:, -1:], hs[:, -1:]
        gain = gs**2 / (hs + RIDGE) + (g_all - gs) ** 2 / (h_all - hs + RIDGE) - g_all**2 / (h_all + RIDGE)
        gain[(ns < LEAST_WEIGHT) | (ns[:, -1:] - ns < LEAST_WEIGHT)] = -1
        best = int(gain.argmax())
        j, b = divmod(best, BINS)
        if gain[j, b] <= 1e-6 or b >= len(edges[j]):
            return me
        goes = bins[rows, j] <= b
        feature[me], cut[me], value[me] = j, edges[j][b], 0.0
        left[me] = node(rows[goes], g, h, depth + 1)
        right[me] = node(rows[~goes], g, h, depth + 1)
        return me

    for _ in range(TREES if len(x) else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (p - y), weight * p * (1 - p)
        roots.append(node(np.arange(len(x)), g, h, 0))
        one = Trees(*(np.array(c) for c in (feature, cut, left, right, value, roots[-1:])), 0.0, DEPTH)
        at = np.full(len(x), roots[-1])
        for _ in range(DEPTH):
            at = np.where(x[np.arange(len(x)), one.feature[at]] <= one.cut[at], one.left[at], one.right[at])
        total += one.value[at]
    columns = (feature or [0], cut or [np.inf], left or [0], right or [0], value or [0.0], roots or [0])
    return Trees(*(np.array(c) for c in columns), bias, DEPTH)


def _statistics_of(documents: DataFrame, more: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in more), pa.array(list(statistics(data, offsets)), pa.list_(pa.float64()))], [*more, "statistics"])

    kinds = [f"{c} {documents.schema[c].dataType.simpleString()}" for c in more]
    return documents.select("text", *more).mapInArrow(run, ", ".join([*kinds, "statistics array<double>"]))


def train(labels: DataFrame, documents: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = SAMPLE_A_CLASS) -> Trees:
    """Grown on at most rows labelled texts of each class, weighted back to the classes' true shares. With labels of one
    class, or none, the trees have a bias alone."""
    sample, counts = sample_labelled(labels, documents, label, rows, key, text)
    got = _statistics_of(sample, ["label"]).collect()
    y = np.array([r["label"] for r in got], float)
    x = np.array([r["statistics"] for r in got]).reshape(len(got), len(STATISTICS))
    seen = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, counts.get(1, 0) / seen[1], counts.get(0, 0) / seen[0])
    return grow(x, y, weight / weight.mean() if len(y) else weight)


def score(documents: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score, 0 to 1, of each whole text. A null text is as an empty one: all its statistics are 0. Repeated rows
    repeat, an empty table gives an empty one, other columns are ignored. Nothing is shuffled; the trees have a fixed
    size."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(trees.score(statistics(data, offsets)))], ["id", "score"])

    return documents.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", key)
