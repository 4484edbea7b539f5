"""Cubes, sketches, funnels and waiting calls against Spark's own, exact values, and plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import funnels, lattice, limits, sketches


@pytest.mark.parametrize("dimensions", [["a"], ["a", "b"], ["a", "b", "c"]])
def test_cube(spark, dimensions):
    rnd = random.Random(1)
    df = spark.createDataFrame([(rnd.choice(["x", "y", None]), rnd.randint(0, 3), rnd.choice([True, None]), rnd.randint(-5, 5)) for _ in range(300)], "a string, b int, c boolean, v long")
    found = lattice.cube(df, dimensions, {"n": ("sum", F.lit(1).cast("long")), "s": ("sum", F.col("v")), "top": ("max", F.col("v"))})
    own = df.cube(*dimensions).agg(F.grouping_id().cast("int").alias("grouping_id"), F.count("*").alias("n"), F.sum("v").alias("s"), F.max("v").alias("top")).select(found.columns)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, own.collect()), key=repr)
    assert lattice.cube(df.limit(0), dimensions, {"n": ("sum", F.lit(1))}).collect() == []


def test_sketches_within_their_bounds(spark):
    """Many more values than a sketch keeps, and spans of one, some and all days."""
    days = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 20 as int), 0, 0, 0)"
    rows = spark.range(200_000).selectExpr(f"{days} AS ts", "id % 2 = 0 AS even", "pmod(xxhash64(id), 60000) AS user", "cast(pmod(xxhash64(id, 1), 1000003) as double) AS value")
    stored = sketches.daily(rows, "ts", ["even"], "user", "value")
    spans = spark.sql("SELECT DATE '2024-01-01' AS first, DATE '2024-01-01' AS last UNION ALL SELECT DATE '2024-01-03', DATE '2024-01-09' UNION ALL SELECT DATE '2024-01-01', DATE '2024-02-20' UNION ALL SELECT DATE '2025-01-01', DATE '2025-01-02'")
    shares = [0.01, 0.5, 0.95]
    said = sketches.spans(stored, spans, ["even"], shares).collect()
    assert len(said) == 5  # even days have even numbers alone, and the last span has no rows
    for r in said:
        own = rows.where(F.to_date("ts").between(r["first"], r["last"]) & (F.col("even") == r["even"]))
        n, users = own.agg(F.count("*"), F.count_distinct("user")).first()
        assert r["n"] == n and abs(r["distinct"] - users) <= 3 * sketches.DISTINCT_ERROR * users
        for s in shares:
            q = r[f"q{round(100 * s)}"]
            below, at = own.agg(F.count_if(F.col("value") < q), F.count_if(F.col("value") <= q)).first()
            assert below - sketches.RANK_ERROR * n - 1 <= s * n <= at + sketches.RANK_ERROR * n + 1


def test_funnels(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 2, 3, 4, None]), rnd.choice("abcx"), rnd.choice([None, *range(40)])) for _ in range(200)] + [(7, "b", 1), (8, "a", 5), (8, "b", 5), (8, "b", 6)]
    found = {tuple(r) for r in funnels.funnel(spark.createDataFrame(rows, "k long, kind string, at long"), "k", "kind", "at", ["a", "b", "a"]).collect()}

    def steps(k):
        times, last = [], None
        for s in ("a", "b", "a"):
            able = [t for key, kind, t in rows if key == k and kind == s and t is not None and (last is None or t > last)]
            if not able:
                break
            last = min(able)
            times.append(last)
        return (k, len(times), *times, *[None] * (3 - len(times)))

    assert found == {steps(k) for k in (1, 2, 3, 4, 7, 8)}
    long = spark.range(50_000).selectExpr("1L AS k", "CASE WHEN id % 20000 = 19999 THEN 'hit' ELSE 'no' END AS kind", "id AS at")  # more than a batch of one key
    assert [tuple(r) for r in funnels.funnel(long, "k", "kind", "at", ["hit", "hit", "hit"]).collect()] == [(1, 2, 19999, 39999, None)]
    assert funnels.funnel(long.limit(0), "k", "kind", "at", ["hit"]).collect() == []


@pytest.mark.parametrize(("rate", "burst"), [(2.0, 3), (0.5, 1), (25.0, 50)])
def test_call_starts(spark, rate, burst):
    """Against a bucket that is filled and emptied call by call."""
    rnd = random.Random(4)
    rows, now = [], 0
    for i in range(300):
        now += rnd.choice([0, 10_000, 100_000, 333_333, 5_000_000])
        rows.append((rnd.choice("ab"), now, i))
    found = {r["i"]: (r["start"], r["delay"]) for r in limits.call_starts(spark.createDataFrame([*rows, ("a", None, -1)], "k string, at long, i int"), ["k"], "at", ["i"], rate, burst, 100_000).collect()}
    assert found.pop(-1) == (None, None)
    step, full = round(1e6 / rate), {}
    for k, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        before = full.get(k)
        token = at if before is None else max(at, before - (burst - 1) * step)
        full[k] = max(at, at if before is None else before) + step
        polls = -(-(token - at) // 100_000)
        assert found[i] == (at + polls * 100_000, polls * 100_000)
    assert any(d for _, d in found.values()) == (burst < 50)
