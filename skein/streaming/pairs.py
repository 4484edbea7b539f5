"""Joins of two streams by key and time, with state bounded by both watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def followed_by(first: DataFrame, then: DataFrame, keys: Sequence[str], at: str, within: str, delay: str, how: str = "leftOuter") -> DataFrame:
    """Each row of first with each row of then that has its keys and comes not before it and at most within after it; with
    leftOuter, rows of first that none follows have nulls.

    Names of then, but for the keys, must differ from those of first; its time is then_<at>. A row waits in the state until
    the watermark says that nothing can join it any more; only then does a row without a match appear. Rows without a time
    or key join nothing and are left out.
    """
    known = lambda rows: rows.where(" and ".join(f"{c} is not null" for c in (*keys, at)))
    left = known(first).withWatermark(at, delay)
    right = known(then).withColumnRenamed(at, f"then_{at}").withWatermark(f"then_{at}", delay)
    for k in keys:
        right = right.withColumnRenamed(k, f"then_{k}")
    same = " and ".join(f"{k} = then_{k}" for k in keys)
    joined = left.join(right, F.expr(f"{same} and then_{at} >= {at} and then_{at} <= {at} + interval {within}"), how)
    return joined.drop(*(f"then_{k}" for k in keys))
