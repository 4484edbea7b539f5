"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training: (1) the n-grams of a bounded sample of labelled texts are counted by class, a text counting once for each;
(2) those whose shares in the two classes differ significantly stay, with their log-count ratio as value; (3) logistic
regression fits a weight for each on the same sample, with class weights that restore the classes' true shares.
Scoring reads whole texts and needs only the table of kept n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, mix, saved

ORDERS = (3, 4, 5)
#: Bits of an n-gram's bucket.
BITS = 22
#: Labelled texts of each class in the sample: those with the smallest hashes of their keys.
SAMPLE_A_CLASS = 5000
#: The standard errors by which an n-gram's shares in the two classes must differ; all such n-grams are kept.
LEAST_Z = 4.5
#: Texts that an n-gram must occur in to be kept.
LEAST_TEXTS = 4
SMOOTHING, RIDGE, STEPS = 0.5, 1.0, 40


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, one after the other, and each text's first."""
    low = [t.lower() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def ngram_buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of each n-gram and the row it is in. No n-gram crosses two texts."""
    points, offsets = _points(texts)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    wide = points.astype(np.uint64)
    for n in ORDERS:
        if len(points) >= n:
            with np.errstate(over="ignore"):
                total = np.full(len(points) - n + 1, n, np.uint64)
                for k in range(n):
                    total = total * np.uint64(0x100000001B3) + wide[k : len(points) - n + 1 + k]
            same = np.flatnonzero(row[: len(total)] == row[n - 1 :])
            yield (mix(total[same]) >> np.uint64(64 - BITS)).astype(np.int32), row[same]


def _text_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    texts, at, held, start = batch.column("text").to_pylist(), 0, 0, 0
    for at, t in enumerate(texts):
        held += len(t or "")
        if held > BLOCK_BYTES // 2 or at + 1 == len(texts):
            yield start, [x or "" for x in texts[start : at + 1]]
            start, held = at + 1, 0


@dataclass
class Model:
    """Buckets, ascending, and the product of ratio and weight for each."""

    buckets: np.ndarray
    values: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        known = np.zeros(1 << BITS, bool)
        known[self.buckets] = True
        pairs = [np.zeros(0, np.int64)]
        for bucket, row in ngram_buckets(texts):
            at = np.flatnonzero(known[bucket])
            pairs.append(row[at].astype(np.int64) << BITS | bucket[at])
        pairs = np.unique(np.concatenate(pairs))
        np.add.at(total, pairs >> BITS, self.values[np.searchsorted(self.buckets, pairs & ((1 << BITS) - 1))])
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def sample_labelled(labels: DataFrame, documents: DataFrame, label: str, rows: int, key: str, text: str) -> tuple[DataFrame, dict[int, int]]:
    """Texts and labels of at most so many labelled keys of each class, and the classes' counts among all labels. Of several
    labels of one key the larger counts; a key with several texts has its label on each of them."""
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    some = None
    for c in counts:
        one = known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(rows)
        some = one if some is None else some.unionAll(one)
    if some is None:
        some = known
    return documents.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id").select("id", "text", "label"), counts


def train(labels: DataFrame, documents: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", rows: int = SAMPLE_A_CLASS) -> Model:
    """Without a label of each class, the model has a bias alone: the share of the class that there is, or 1/2."""
    sample, counts = sample_labelled(labels, documents, label, rows, key, text)
    if len(counts) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), {(): 0.0, (0,): -4.0, (1,): 4.0}[tuple(counts)])
    sample = saved(sample.repartition("id"), "toxicity-sample")
    seen = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(counts[1] / counts[0])))
    has, hasnt = seen[1], seen[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            label = np.array(batch.column("label"))
            for start, texts in _text_blocks(batch):
                pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(row.astype(np.int64) << BITS | bucket for bucket, row in ngram_buckets(texts))]))
                mine = label[start + (pairs >> BITS)]
                for c in (0, 1):
                    total[c] += np.bincount((pairs & ((1 << BITS) - 1))[mine == c], minlength=1 << BITS)
        at = np.flatnonzero(total.sum(axis=0))
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[1][some]), pa.array(total[0][some])], ["bucket", "p", "q"])

    sums = sample.mapInArrow(count, "bucket int, p int, q int").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    share = (F.col("p") + F.col("q")) / F.lit(float(has + hasnt))
    z = F.abs(F.col("p") / F.lit(float(has)) - F.col("q") / F.lit(float(hasnt))) / F.sqrt(share * (1 - share) * F.lit(1 / has + 1 / hasnt) + F.lit(1e-12))
    ratio = F.ln((F.col("p") + SMOOTHING) / (F.col("q") + SMOOTHING)) - F.ln(F.lit((has + 2 * SMOOTHING) / (hasnt + 2 * SMOOTHING)))
    kept = sums.where(F.col("p") + F.col("q") >= LEAST_TEXTS).select("bucket", ratio.alias("ratio"), z.alias("z")).where(F.col("z") >= LEAST_Z).toArrow()  # no more than there are buckets
    by = np.argsort(np.array(kept.column("bucket")))
    buckets, ratios = np.array(kept.column("bucket"), np.int64)[by], np.array(kept.column("ratio"), float)[by]

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_pylist()
            for start, texts in _text_blocks(batch):
                own: list[np.ndarray] = [np.zeros(0, np.int64)]
                for bucket, row in ngram_buckets(texts):
                    place = np.minimum(np.searchsorted(buckets, bucket), max(len(buckets) - 1, 0))
                    at = np.flatnonzero(buckets[place] == bucket) if len(buckets) else place[:0]
                    own.append(row[at].astype(np.int64) << BITS | place[at])
                pairs = np.unique(np.concatenate(own))
                cut = np.searchsorted(pairs >> BITS, np.arange(len(texts) + 1))
                rows = [(pairs[a:b] & ((1 << BITS) - 1)).astype(np.int32) for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(label[start : start + len(texts)], pa.int32())], ["features", "label"])

    got = sample.mapInArrow(present, "features array<int>, label int").toArrow().combine_chunks()
    lists = got.column("features").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    y = np.array(got.column("label"), float)
    x = Presence(np.array(lists.flatten()), np.array(lists.value_lengths(), np.int64), ratios)
    weight = np.where(y == 1, counts[1] / has, counts[0] / hasnt)
    weights, bias = _logistic(x, y, weight / weight.mean())
    return Model(buckets, weights * ratios, bias)


@dataclass
class Presence:
    """A sparse matrix: which features each text has, times their scale."""

    feature: np.ndarray
    count: np.ndarray
    scale: np.ndarray

    def by_text(self, v: np.ndarray) -> np.ndarray:
        """The matrix times a value for each feature."""
        total = np.append(0, np.cumsum((self.scale * v)[self.feature]))
        end = np.cumsum(self.count)
        return total[end] - total[end - self.count]

    def by_feature(self, u: np.ndarray) -> np.ndarray:
        """A value for each text times the matrix."""
        return self.scale * np.bincount(self.feature, np.repeat(u, self.count), len(self.scale))


def _logistic(x: Presence, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps whose length the data's curvature bounds."""
    size_x = len(x.scale)
    w, bias = np.zeros(size_x), float(np.log((weight[y == 1].sum() + 1e-9) / (weight[y == 0].sum() + 1e-9)))
    if not size_x:
        return w, bias
    v = np.ones(size_x)
    for _ in range(10):
        v = x.by_feature(weight * x.by_text(v))
        size = float(np.linalg.norm(v)) or 1.0
        v = v / size
    rate_w, rate_b = 1 / (size / 4 + RIDGE), 2 / weight.sum()
    old_w, old_b, look_w, look_b = w, bias, w, bias
    for k in range(STEPS * 5):
        error = weight * (1 / (1 + np.exp(-np.clip(x.by_text(look_w) + look_b, -500, 500))) - y)
        w, bias = look_w - rate_w * (x.by_feature(error) + RIDGE * look_w), look_b - rate_b * error.sum()
        look_w, look_b = w + k / (k + 3) * (w - old_w), bias + k / (k + 3) * (bias - old_b)
        old_w, old_b = w, bias
    return w, float(bias)


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score, 0 to 1, of each whole text. A null or empty text, or one shorter than an n-gram, has the bias alone.
    Repeated rows repeat, an empty table gives an empty one, other columns are ignored. Nothing is shuffled; the model has
    at most an entry for each of the 2^BITS buckets."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(texts) for _, texts in _text_blocks(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate([np.zeros(0), *scores]))], ["id", "score"])

    return documents.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", key)
