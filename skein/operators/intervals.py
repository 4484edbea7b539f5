"""Interval joins by a hierarchical index of bins, without nested loops.

Whole numbers are put in bins of 2^level values. An interval is the disjoint union of at most two bins a level, its
canonical cover, of O(log length) bins in all; a point is in one bin of each level. So a point lies in an interval if and
only if exactly one of its bins is in the interval's cover: an equi-join by (level, bin) gives each pair once. Where only
counts are asked for, intervals are added up by bin before they meet any point, so that pairs are never made. Where pairs
are asked for, bins as wide as the interval do with less: it is in two at most, and its ends are compared.

A point is looked up once for each level. Times in microseconds have many, so the levels can start at a finest one: an
interval's ends then lie in up to two bins that it covers in part, and whoever meets it there is held against it exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of bins: intervals are of less than 2^LEVELS values.
LEVELS = 62


def micros(at: Column) -> Column:
    """A time without zone as microseconds since 1970, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def cover(low: str, high: str, finest: int = 0) -> Column:
    """The cover of [low, high], both ends in, as an array of (level, bin, part); empty if high is below low. Inside, a level
    adds its leftmost bin where that is a right child, and its rightmost where that is a left child. Bins of the finest
    level that an end cuts are marked as parts."""
    left = f"shiftright({low} + (shiftleft(1L, k) - 1), k)"
    right = f"shiftright({high} + 1, k)"
    bin_ = lambda level, place, part: f"named_struct('level', {level}, 'bin', {place}, 'part', {part})"
    some = f"array(CASE WHEN {left} & 1 = 1 THEN {bin_('k', left, 'false')} END, CASE WHEN {right} & 1 = 1 THEN {bin_('k', f'{right} - 1', 'false')} END)"
    whole = f"flatten(transform(filter(sequence({finest}, {LEVELS - 1}), k -> {left} < {right}), k -> {some}))"
    mask = (1 << finest) - 1
    cut = lambda place, end: f"CASE WHEN {low} <= {high} AND ({place} & {mask}L) <> 0 THEN {bin_(str(finest), f'shiftright({end}, {finest})', 'true')} END"
    parts = f"array_distinct(array({cut(low, low)}, {cut(f'({high} + 1)', high)}))"
    return F.expr(f"filter(concat({whole}, {parts}), b -> b is not null)")


def _binned(intervals: DataFrame, low: str, high: str, finest: int) -> DataFrame:
    """The intervals' rows, one for each bin of their covers."""
    return intervals.where(f"{low} <= {high}").select("*", F.inline(cover(low, high, finest)).alias("_level", "_bin", "_part"))


def _placed(points: DataFrame, at: str, levels: list[int]) -> DataFrame:
    """The points' rows, one for each level that intervals use."""
    some = F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("_level")
    return points.where(f"{at} is not null").select("*", some).withColumn("_bin", F.expr(f"shiftright({at}, _level)"))


def _levels(intervals: DataFrame, low: str, high: str, finest: int) -> list[int]:
    """Levels that covers use: those up to the bit length of the longest interval, which an aggregate finds."""
    longest = intervals.where(f"{low} <= {high}").agg(F.max(F.col(high) - F.col(low))).first()[0]
    return [] if longest is None else list(range(finest, max(finest + 1, (longest + 1).bit_length())))


def _width(low: str, high: str, finest: int) -> Column:
    """The level whose bins are wider than [low, high], which then touches two of them at most."""
    return F.greatest(F.length(F.bin(F.col(high) - F.col(low))), F.lit(finest)).cast("int")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, keys: Sequence[str] = (), finest: int = 0) -> DataFrame:
    """Each point (a long) with each interval [low, high] (longs) that it lies in and whose keys it shares: all columns of
    both, the keys once. Nulls in either lie in nothing. The tables' other columns must differ by name.

    An interval is kept in the one or two bins of its own width that it touches, and not in its cover, which would be
    shuffled some twenty times; a point is looked up once for each width in use, and held against the interval exactly."""
    wide = intervals.where(f"{low} <= {high}").withColumn("_level", _width(low, high, finest))
    levels = sorted(r[0] for r in wide.select("_level").distinct().collect())  # at most 64
    bins = F.expr(f"sequence(shiftright({low}, _level), shiftright({high}, _level))")
    pairs = _placed(points, at, levels).join(wide.withColumn("_bin", F.explode(bins)), [*keys, "_level", "_bin"])
    return pairs.where(f"{at} between {low} and {high}").drop("_level", "_bin")


def interval_counts(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, keys: Sequence[str] = (), name: str = "n", finest: int = 0) -> DataFrame:
    """The points, each with the number of intervals that it lies in and whose keys it shares; also where these are far more
    than could be paired. A point with a null lies in none. Points of one place are counted once and joined back. Pairs are
    made in the bins of the finest level that intervals end in, and of equal ends one pair."""
    levels = _levels(intervals, low, high, finest)
    ends = intervals.groupBy(*keys, low, high).agg(F.count("*").alias("_n"))
    bins = _binned(ends, low, high, finest)
    whole = bins.where("not _part").groupBy(*keys, "_level", "_bin").agg(F.sum("_n").alias("_n"))
    places = points.select(*keys, at).distinct()
    met = _placed(places, at, levels).join(whole, [*keys, "_level", "_bin"]).select(*keys, at, "_n")
    if finest:
        cut = _placed(places, at, [finest]).join(bins.where("_part"), [*keys, "_level", "_bin"]).where(f"{at} between {low} and {high}")
        met = met.unionAll(cut.select(*keys, at, "_n"))
    counts = met.groupBy(*keys, at).agg(F.sum("_n").alias("_n"))
    return points.join(counts, [*keys, at], "left").select(*points.columns, F.coalesce("_n", F.lit(0)).alias(name))
