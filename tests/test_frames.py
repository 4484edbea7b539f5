"""Moving aggregates against a plain loop, over hot keys, ties, nulls and frames of all widths."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skein.operators.frames import moving

MEASURES = {"total": ("sum", "x"), "n": ("count", "x"), "low": ("min", "y"), "top": ("max", "x")}


def table(n: int = 250) -> list[tuple]:
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 7 + ["a", None]), rnd.choice([None, *range(-90, 90)]), rnd.choice([None, rnd.randint(-9, 9)]), rnd.choice([None, 0.5, -2.25]), i) for i in range(n)]
    return [*rows, rows[0], ("alone", 5, None, None, n), ("far", -(1 << 51), 1, 1.0, n), ("far", 1 << 51, 2, 2.0, n)]


def expected(rows: list[tuple], before: int, after: int, keyed: bool) -> list[tuple]:
    out = []
    for k, at, x, y, i in rows:
        if at is None or keyed and k is None:
            out.append((k, at, x, y, i, None, None, None, None))
            continue
        seen = [r for r in rows if r[1] is not None and at - before <= r[1] <= at + after and (not keyed or r[0] == k)]
        xs, ys = [r[2] for r in seen if r[2] is not None], [r[3] for r in seen if r[3] is not None]
        out.append((k, at, x, y, i, sum(xs) if xs else None, len(xs), min(ys, default=None), max(xs, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sliced", [True, False])
@pytest.mark.parametrize(("before", "after", "keyed"), [(0, 0, True), (7, 0, True), (3, 11, True), (0, 500, False), (40, 1, False)])
def test_moving(spark, before, after, keyed, sliced):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", not sliced)
    try:
        rows = table()
        df = spark.createDataFrame(rows, "k string, at long, x long, y double, i int").repartition(4)
        found = moving(df, ["k"] if keyed else [], "at", before, after, MEASURES)
        assert found.columns == [*df.columns, *MEASURES]
        assert sorted(map(tuple, found.collect()), key=repr) == expected(rows, before, after, keyed)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_moving_on_awkward_tables(spark):
    df = spark.createDataFrame([("a", 1, 2)], "`k.x` string, at int, _of int")
    assert moving(df.limit(0).drop("_of", "k.x"), [], "at", 1, 1, {"n": ("count", "at")}).collect() == []
    with pytest.raises(ValueError):
        moving(df, [], "at", -1, 0, {"n": ("count", "at")})
    with pytest.raises(ValueError):
        moving(df, [], "at", 1, 0, {"n": ("mean", "at")})


def test_moving_without_a_window(spark):
    """All rows as one group, with frames of a thousand rows: no window, no nested loop, no row beside another."""
    df = spark.range(20_000).select(F.col("id").alias("at"), (F.col("id") % 101).alias("x"))
    found = moving(df, [], "at", 999, 0, {"n": ("count", "x"), "top": ("max", "x")})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.where("n <> least(at + 1, 1000) or top <> least(at, 100)").count() == 0
