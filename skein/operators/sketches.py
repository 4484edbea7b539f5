"""Distinct counts and quantiles of any span of days from sketches that are stored once a day.

A day's sketches are binary columns (HyperLogLog for distinct values, KLL for quantiles), made by partial aggregates in one
pass. A span merges the sketches of its days, a few kilobytes each, and reads none of the rows. The bounds below are those
of the sketches; with so few values that a sketch keeps them all, its answers are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithm of the HLL's registers, and its relative standard error, 1.04 / sqrt(2^LOG_REGISTERS).
LOG_REGISTERS = 12
DISTINCT_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)
#: Values that a KLL level keeps, and the error of ranks that goes with it with 99 % confidence, as a share of all rows.
KLL_SIZE = 2048
RANK_ERROR = 0.0015


def daily(rows: DataFrame, at: str, keys: Sequence[str], distinct: str, value: str) -> DataFrame:
    """(day, keys, n, users, quantiles): for each day of a time and each group the rows, a sketch of a column's distinct
    values and one of a double's quantiles. Rows without a time are left out, nulls in the other columns count as no value."""
    day = F.to_date(at).alias("day")
    users = F.hll_sketch_agg(distinct, LOG_REGISTERS).alias("users")
    return rows.where(F.col(at).isNotNull()).groupBy(day, *keys).agg(F.count("*").alias("n"), users, F.kll_sketch_agg_double(value, F.lit(KLL_SIZE)).alias("quantiles"))


def spans(sketches: DataFrame, wanted: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(first, last, keys, n, distinct, q<share>...) for each wanted span of days (first, last, both in) and each group that
    has rows in it. Days meet spans by an equi-join on the days of each span."""
    days = wanted.select("first", "last", F.explode(F.sequence("first", "last")).alias("day"))
    met = sketches.join(days, "day").groupBy("first", "last", *keys)
    merged = met.agg(F.sum("n").alias("n"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("quantiles").alias("quantiles"))
    quantiles = [F.kll_sketch_get_quantile_double("quantiles", F.lit(s)).alias(f"q{round(100 * s)}") for s in shares]
    return merged.select("first", "last", *keys, "n", F.hll_sketch_estimate("users").alias("distinct"), *quantiles)
