"""Ranks, tiles and exact percentiles over groups of any size, without gathering a group.

Ranks are running counts (see scan.py): the place of a row in its group is what its slice starts with and its place in the
slice. Percentiles are found without a sort: counts by equal parts of each group's range of values say in which part the
wanted places lie, which becomes the range of the next round, until a part holds one value alone.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.scratch import saved

from .scan import Running, running

#: Parts that a range is cut into each round.
PARTS = 256
#: Ranges (a row of some 50 bytes for each group and place) up to which they are broadcast rather than joined by a shuffle.
BROADCAST_ROWS = 100_000


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with row_number (from 1, in the order, which should be total) and size (of the group)."""
    out = running(rows.withColumn("_one", F.lit(1).cast("long")), keys, order, {"row_number": Running("sum", "_one")}).drop("_one")
    if not keys:
        return out.withColumn("size", F.lit(rows.count()).cast("long"))
    sizes = rows.select(*(F.col(k).alias(f"_{k}") for k in keys)).groupBy(*(f"_{k}" for k in keys)).agg(F.count("*").alias("size"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return out.join(sizes, same).drop(*(f"_{k}" for k in keys))


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """numbered, and rank and dense_rank by the columns order alone, of which ties make a total order."""
    by = [*order, *ties]
    places = numbered(rows, keys, by)
    # the first of each group of equals, carried over it
    heads = places.groupBy(*keys, *order).agg(F.min("row_number").alias("row_number"))
    marked = places.join(heads.withColumn("_first", F.lit(1).cast("long")), [*keys, *order, "row_number"], "left").withColumn("_rank", F.when(F.col("_first").isNotNull(), F.col("row_number")))
    found = running(marked, keys, ["row_number"], {"rank": Running("max", "_rank"), "dense_rank": Running("sum", "_first")})
    return found.drop("_first", "_rank")


def tiles(rows: DataFrame, n: int, keys: Sequence[str], order: Sequence[str], name: str = "tile") -> DataFrame:
    """The rows with the number of their tile: n tiles of each group, in order, of sizes that differ by one at most, the
    larger ones first, as ntile() has them."""
    small, large = F.expr(f"size div {n}"), F.expr(f"size % {n}")
    place = F.col("row_number") - 1
    edge = large * (small + 1)
    tile = F.when(place < edge, F.expr(f"(row_number - 1) div (size div {n} + 1)")).otherwise(large + F.expr(f"try_divide(row_number - 1 - (size % {n}) * (size div {n} + 1), size div {n})").cast("long"))
    return numbered(rows, keys, order).withColumn(name, (tile + 1).cast("long")).drop("row_number", "size")


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, share, percentile): the exact percentiles of a double column in each group, interpolated between the two rows
    at whose places the share falls, as percentile_cont. Nulls do not count; a group without values, and one with a null
    key, has no row; NaN and infinities are not allowed.

    A round reads the values once and counts, in each task, by group, place and part; there are at most two places a share.
    What is kept between rounds is a row for each group and place. A round narrows the ranges 256-fold, so about seven are
    needed for any doubles; groups whose values differ less need fewer.
    """
    own = [f"_k{i}" for i in range(len(keys))] or ["_all"]
    some = rows.select(*([F.col(k).alias(n) for k, n in zip(keys, own, strict=True)] if keys else [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v")).where("_v is not null")
    sizes = some.groupBy(*own).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    each = F.explode(F.array(*map(F.lit, shares)).cast("array<double>")).alias("share")
    wanted = saved(sizes.select(*own, each, "_n", "_low", "_high").withColumn("_at", F.expr("share * (_n - 1)")), "wanted")
    place = F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_place")
    # of each group and place: the range its value lies in, and how many values lie below the range
    now = saved(wanted.select(*own, "_low", "_high", place).distinct().withColumn("_below", F.lit(0).cast("long")), "ranges")
    done = []
    while True:
        done.append(now.where("_low = _high").select(*own, "_place", F.col("_low").alias("_value")))
        left = now.where("_low < _high")
        if not (number := left.count()):
            break
        # few groups would be as few tasks after a shuffle of the values
        held = some.join(F.broadcast(left) if number <= BROADCAST_ROWS else left, own).where("_v between _low and _high")
        width = F.col("_high") / PARTS - F.col("_low") / PARTS
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("_v") - F.col("_low")) / width)).cast("int")
        counts = held.groupBy(*own, "_place", "_below", part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        parts = counts.groupBy(*own, "_place", "_below").agg(F.array_sort(F.collect_list(F.struct("_part", "_c", "_least", "_most"))).alias("_parts"))  # PARTS entries at most
        none = "named_struct('seen', _below, 'below', _below, 'low', cast(null as double), 'high', cast(null as double))"
        found = "aggregate(_parts, {}, (s, p) -> CASE WHEN s.low is null and s.seen + p._c > _place THEN named_struct('seen', s.seen + p._c, 'below', s.seen, 'low', p._least, 'high', p._most) ELSE named_struct('seen', s.seen + p._c, 'below', s.below, 'low', s.low, 'high', s.high) END)"
        now = saved(parts.withColumn("_s", F.expr(found.format(none))).select(*own, F.col("_s.low").alias("_low"), F.col("_s.high").alias("_high"), "_place", F.col("_s.below").alias("_below")), "ranges")
    values = functools.reduce(DataFrame.unionAll, done)
    at = lambda name, side: values.select(*own, F.col("_place").alias(name), F.col("_value").alias(side))
    ends = wanted.withColumns({"_floor": F.floor("_at"), "_ceil": F.ceil("_at")})
    both = ends.join(at("_floor", "_a"), [*own, "_floor"]).join(at("_ceil", "_b"), [*own, "_ceil"])
    return both.select(*(F.col(n).alias(k) for k, n in zip(keys, own, strict=False)), "share", F.expr("_a + (_at - _floor) * (_b - _a)").alias("percentile"))
