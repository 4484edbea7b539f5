"""How filters of documents act together: what each removes alone, after others, and on average over all orders.

Each document gets a mask of the filters that it fails. Masks are counted for each part (a source, say) by partial
aggregates, beside the good and the toxic documents among them. The subset-zeta transform turns a part's 2^k counts into
the survivors of every subset of filters: after bit j of k is done, a cell holds the sum over all masks that agree with it
on the bits still to come and lie within it on those done. What an order of filters removes at a step is then a difference
between two neighbouring subsets, and so are the labels lost; Shapley values are weighted sums of such differences. All of
this is for arrays of 2^k numbers a part, in batches of parts, whatever the number of documents.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Least words, least distinct words and most capitals in hundredths, and the characters of filter D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"
#: Numbers of a part and mask: documents, good ones, toxic ones.
_KINDS = ("n", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """The conditions by which a whole text fails filters A to D. A null text is empty."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        "C": 100 * F.regexp_count(whole, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(whole),
        "D": whole.rlike(SYMBOLS),
    }


def repeated(rows: DataFrame, key: str, digest: str) -> Column:
    """Marker column for rows joined with first_of(): the row's text is that of a smaller key."""
    return F.col(key).isNotNull() & F.col("first_key").isNull()


def first_of(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, digest, first_key): the smallest key of each text. Copies are aggregated in each task before any shuffle, and
    rows meet their text's smallest key by key and text, so that a text with a third of all rows is no hot key."""
    least = rows.where(F.col(key).isNotNull()).groupBy(digest).agg(F.min(key).alias(key))
    return least.select(key, digest, F.col(key).alias("first_key"))


def masks(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters A to E that they fail, bit 0 for A.

    A null part is the empty string. A row with a null key is no copy of another and no other is one of it, and has no
    labels; rows equal in key and text are no copies of each other. Of several labels of one key the larger counts.
    """
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    failed = [condition.cast("int") * (1 << k) for k, condition in enumerate(text_filters(F.col("text")).values())]
    mask = failed[0] + failed[1] + failed[2] + failed[3]
    rows = saved(rows.select("key", "part", mask.alias("mask"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")), "masks")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    keyed = rows.where("key is not null").join(first_of(rows, "key", "digest"), ["key", "digest"], "left").join(marks, "key", "left")
    keyed = keyed.select("part", (F.col("mask") + 16 * repeated(keyed, "key", "digest").cast("int")).alias("mask"), *(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long").alias(c) for c in _KINDS[1:]))
    unkeyed = rows.where("key is null").select("part", "mask", *(F.lit(0).cast("long").alias(c) for c in _KINDS[1:]))
    return keyed.unionAll(unkeyed).groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in _KINDS[1:]))


def survivors(counts: np.ndarray) -> np.ndarray:
    """Of counts by mask (parts, 2^k, kinds): what is left once the filters of each subset have been applied. A document is
    left if its mask lies within the subset's complement."""
    within = counts.copy()
    size = counts.shape[1]
    for j in range(size.bit_length() - 1):
        halves = within.reshape(len(counts), size >> j + 1, 2, 1 << j, -1)
        halves[:, :, 1] += halves[:, :, 0]
    return within[:, ::-1]  # the complement of subset s is size - 1 - s


def steps(filters: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders of the filters, and for each order and step the subset applied before and the filter's number."""
    orders = ["".join(p) for p in itertools.permutations(filters)]
    numbers = np.array([[filters.index(c) for c in o] for o in orders])
    before = np.cumsum(1 << numbers, axis=1) - (1 << numbers)
    return orders, before, numbers


def audit(counts: DataFrame, filters: str = "ABCDE", part: str = "part") -> DataFrame:
    """A row for each part, order of the filters (all of them) and step, zeros included: kept, removed, redundant (failing
    the step's filter, but removed earlier), unique_fails (failing that filter alone), good_lost, toxic_lost, and shapley
    (what the filter removes, summed over all orders).

    counts has (part, mask, n, good, toxic); no rows give none. Parts are worked on in batches, each in one task.
    """
    size, k = 1 << len(filters), len(filters)
    cells = [F.array(*(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(size))).alias(c) for c in _KINDS]
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, before, number = steps(filters)
        after = before | 1 << number
        subsets = np.arange(size)
        members = np.bitwise_count(subsets)
        weight = np.array([math.factorial(m) * math.factorial(max(0, k - 1 - m)) for m in members.tolist()])
        for batch in batches:
            table = np.stack([np.array(batch.column(c).flatten()).reshape(-1, size) for c in _KINDS], 2)
            left = survivors(table)
            lost = left[:, before] - left[:, after]  # (parts, orders, steps, kinds)
            n = left[:, :, 0]
            shapley = np.stack([(weight * (n - n[:, subsets | 1 << j]) * (subsets >> j & 1 == 0)).sum(1) for j in range(k)], 1)
            alone = np.stack([table[:, 1 << j, 0] for j in range(k)], 1)
            fails = np.stack([n[:, 0] - n[:, 1 << j] for j in range(k)], 1)
            flat = len(orders) * k
            columns = [n[:, after], lost[..., 0], fails[:, number] - lost[..., 0], alone[:, number], lost[..., 1], lost[..., 2], shapley[:, number]]
            own = pa.array(np.repeat(np.arange(batch.num_rows), flat))
            said = [pa.DictionaryArray.from_arrays(pa.array(np.tile(np.repeat(np.arange(len(orders)), k), batch.num_rows)), pa.array(orders)).cast(pa.string()), pa.array(np.tile(np.arange(1, k + 1), len(orders) * batch.num_rows), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("part").take(own), *said, *(pa.array(c.reshape(-1)) for c in columns)], names)

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names[3:])
    return counts.groupBy(F.col(part).alias("part")).agg(*cells).mapInArrow(run, schema)
