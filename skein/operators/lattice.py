"""Cubes by a lattice: each grouping from the smallest stored one that has a dimension more.

GROUP BY CUBE makes 2^n rows of each input row before it aggregates. Here the input is aggregated once, by all dimensions,
and each coarser level of groupings comes from the states of the level below, which are far fewer: of the groupings that
have one dimension more, each takes the one with the fewest rows.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.scratch import saved

_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def cube(rows: DataFrame, dimensions: Sequence[str], measures: dict[str, tuple[str, Column]]) -> DataFrame:
    """(dimensions, grouping_id, measures) as GROUP BY CUBE has them: bit n - 1 - i of grouping_id is set where dimension i
    is left out, and null. measures says how a column is merged (sum, max or min) and what goes into it, so a count is a
    sum of ones. A null in a dimension is a value of its own. No rows give no rows, not even the total."""
    n = len(dimensions)
    merged = [_MERGE[kind](name).alias(name) for name, (kind, _) in measures.items()]
    base = rows.select(*dimensions, *(c.alias(name) for name, (_, c) in measures.items())).groupBy(*dimensions).agg(*merged)
    level = saved(base.withColumn("grouping_id", F.lit(0)), "lattice")
    levels = [level]
    for _ in range(n):
        sizes = dict(level.groupBy("grouping_id").count().collect())  # a row for each grouping of the level
        source: dict[int, int] = {}
        for mask in sizes:
            for bit in (1 << i for i in range(n)):
                if not mask & bit and (mask | bit not in source or sizes[mask] < sizes[source[mask | bit]]):
                    source[mask | bit] = mask
        if not source:
            break
        heirs = functools.reduce(lambda e, m: e.when(F.col("grouping_id") == m, F.array(*(F.lit(c) for c, p in source.items() if p == m)).cast("array<int>")), sizes, F)
        each = level.withColumn("_child", F.explode(heirs))
        kept = [F.when(F.col("_child").bitwiseAND(1 << n - 1 - i) == 0, F.col(d)).alias(d) for i, d in enumerate(dimensions)]
        level = saved(each.select(F.col("_child").alias("grouping_id"), *kept, *measures).groupBy("grouping_id", *dimensions).agg(*merged).select(*dimensions, *measures, "grouping_id"), "lattice")
        levels.append(level)
    columns = [*dimensions, "grouping_id", *measures]
    return functools.reduce(DataFrame.unionAll, [x.select(columns) for x in levels])
