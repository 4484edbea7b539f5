"""Scans, as-of and interval joins, ranks and percentiles against plain loops, with groups over many slices."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators.asof import asof_join
from skein.operators.intervals import cover, interval_counts, interval_join
from skein.operators.ranks import numbered, percentiles, ranked, tiles
from skein.operators.scan import Running, running


@pytest.fixture(params=[True, False], ids=["coalesced", "sliced"])
def slices(request, spark):
    """Rows in one slice, or in eight."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield request.param
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def hot_rows(seed: int = 1, n: int = 900) -> list[tuple]:
    """Most rows of one key, some of null keys, nulls in the values."""
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["hot"] * 8 + ["a", "b", None])
    return [(key(), i, rnd.choice([None, rnd.randint(-9, 9)]), rnd.choice([None, 0.5, 2.25, -1.0]), rnd.choice([None, None, None, f"s{i}"])) for i in rnd.sample(range(10 * n), n)]


def test_running(spark, slices):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, at long, x long, y double, s string").repartition(5)
    found = running(df, ["k"], ["at"], {"sum": Running("sum", "x"), "top": Running("max", "x"), "low": Running("min", "y"), "said": Running("last", "s")})
    assert found.columns == ["k", "at", "x", "y", "s", "sum", "top", "low", "said"]
    expected, state = [], {}
    for k, at, x, y, s in sorted(rows, key=lambda r: r[1]):
        total, top, low, said = state.get(k, (0, None, None, None))
        state[k] = (total + (x or 0), max((v for v in (top, x) if v is not None), default=None), min((v for v in (low, y) if v is not None), default=None), said if s is None else s)
        expected.append((k, at, x, y, s, *state[k]))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_running_deals_out_a_hot_group(spark):
    """The range shuffle has many partitions with rows of the one key, and no window is in the plan."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        found = running(spark.range(8000).selectExpr("id", "1L AS one"), [], ["id"], {"n": Running("sum", "one")})
        assert found.where("n <> id + 1").count() == 0
        files = found.select(F.spark_partition_id().alias("p"), F.input_file_name().alias("f")).groupBy("f").count().collect()
        assert len(files) == 8 and max(r["count"] for r in files) < 2000
        assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert running(spark.range(0).selectExpr("id", "1L AS one"), [], ["id"], {"n": Running("sum", "one")}).collect() == []
    with pytest.raises(ValueError):
        Running("mean", "one")


@pytest.mark.parametrize("strict", [True, False])
def test_asof(spark, slices, strict):
    rnd = random.Random(4)
    left = [(rnd.choice(["hot"] * 6 + ["a", None]), rnd.choice([None, *range(60)]), i) for i in range(300)]
    right = [(rnd.choice(["hot"] * 6 + ["a", "only right", None]), rnd.choice([None, *range(0, 60, 2)]), rnd.randint(0, 9), f"v{i}") for i in range(80)]
    a = spark.createDataFrame([*left, left[0]], "k string, at int, i int")
    b = spark.createDataFrame(right, "k string, at int, tie int, v string")
    found = asof_join(a, b, ["k"], "at", ["v", "at"], ties=["tie"], strict=strict)
    assert found.columns == ["k", "at", "i", "last_v", "last_at"]

    def last(k, at):
        able = [r for r in right if None not in (k, at, r[0], r[1]) and r[0] == k and (r[1] < at or r[1] == at and not strict)]
        best = max(able, key=lambda r: (r[1], r[2], r[3]), default=None)
        return (best[3], best[1]) if best else (None, None)

    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((k, at, i, *last(k, at)) for k, at, i in [*left, left[0]]), key=repr)
    assert asof_join(a.limit(0), b, ["k"], "at", ["v"]).collect() == []
    assert {r["last_v"] for r in asof_join(a, b.limit(0), ["k"], "at", ["v"]).collect()} == {None}


def spans(seed: int = 2, n: int = 200) -> list[tuple]:
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        low = rnd.randint(-500, 500)
        out.append((rnd.choice(["x", "y", None]), low, low + rnd.choice([-1, 0, 1, 7, 64, 300]), i))
    return [*out, ("x", None, 5, n), ("x", 5, None, n + 1), ("x", -(1 << 50), 1 << 50, n + 2)]


@pytest.mark.parametrize("finest", [0, 1, 4, 12])
def test_covers(spark, finest):
    rows = spark.createDataFrame([r for r in spans() if None not in r[1:3] and r[2] - r[1] < 1000], "k string, low long, high long, i int").select("low", "high", cover("low", "high", finest).alias("c")).collect()
    for low, high, bins in rows:
        inside = [v for level, b, part in bins for v in range(b << level, (b + 1) << level) if not part or low <= v <= high]
        assert sorted(inside) == list(range(low, high + 1)) and len(bins) <= 2 * max(1, (high - low + 1).bit_length())
        assert all(level >= finest for level, _, _ in bins) and (finest or not any(part for _, _, part in bins))


@pytest.mark.parametrize("finest", [0, 3, 7])
def test_interval_joins(spark, finest):
    rnd = random.Random(9)
    points = [(rnd.choice(["x", "y", None]), rnd.choice([None, *range(-600, 600)]), i) for i in range(150)]
    p = spark.createDataFrame([*points, points[0]], "k string, at long, id int")
    v = spark.createDataFrame([*spans(), spans()[3]], "k string, low long, high long, i int")
    every, all_spans = [*points, points[0]], [*spans(), spans()[3]]
    hit = lambda at, s: None not in (at, s[1], s[2]) and s[1] <= at <= s[2]
    found = interval_join(p.select("at", "id"), v.drop("k"), "at", "low", "high", finest=finest)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["i"]) for r in found.collect()) == sorted((i, s[3]) for _, at, i in every for s in all_spans if hit(at, s))
    keyed = interval_join(p, v, "at", "low", "high", ["k"], finest).collect()
    assert sorted((r["id"], r["i"]) for r in keyed) == sorted((i, s[3]) for k, at, i in every for s in all_spans if k is not None and k == s[0] and hit(at, s))
    counts = interval_counts(p, v, "at", "low", "high", ["k"], finest=finest).collect()
    assert sorted(map(tuple, counts), key=repr) == sorted(((k, at, i, sum(k is not None and k == s[0] and hit(at, s) for s in all_spans)) for k, at, i in every), key=repr)
    assert {r["n"] for r in interval_counts(p, v.limit(0), "at", "low", "high").collect()} == {0}


def test_ranks(spark, slices):
    rnd = random.Random(6)
    rows = [(rnd.choice(["hot"] * 5 + ["a", None]), rnd.randint(0, 30), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    groups: dict = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    place = {r: n for g in groups.values() for n, r in enumerate(g, 1)}
    assert {tuple(r)[:3]: (r["row_number"], r["size"]) for r in numbered(df, ["k"], ["v", "i"]).collect()} == {r: (n, len(groups[r[0]])) for r, n in place.items()}
    some = df.where("k is not null")
    found = {tuple(r)[:3]: (r["rank"], r["dense_rank"]) for r in ranked(some, ["k"], ["v"], ["i"]).select("k", "v", "i", "rank", "dense_rank").collect()}
    assert found == {r: (1 + sum(x[1] < r[1] for x in groups[r[0]]), len({x[1] for x in groups[r[0]] if x[1] <= r[1]})) for r in rows if r[0] is not None}
    for n in (1, 7, 1000):
        whole = {tuple(r)[:3]: r["tile"] for r in tiles(df, n, [], ["v", "i"]).collect()}
        window = {tuple(r)[:3]: r["t"] for r in df.selectExpr("*", f"ntile({n}) over (order by v, i) as t").collect()}
        assert whole == window


@pytest.mark.parametrize("limit", [100_000, 0])
def test_percentiles(spark, monkeypatch, limit):
    from skein.operators import ranks

    monkeypatch.setattr(ranks, "BROADCAST_ROWS", limit)
    rnd = random.Random(8)
    values = {"hot": [rnd.choice([rnd.gauss(0, 1e6), 5.0, -0.0, 1e-300, 3e300]) for _ in range(700)], "one": [4.5], "same": [2.0] * 9, "two": [1.0, 2.0], "near": [1e5, np.nextafter(1e5, 2e5), 1e5]}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("none", None), ("one", None), (None, 7.0)]
    shares = [0.0, 0.3, 0.5, 0.99, 1.0]
    found = {(r["k"], r["share"]): r["percentile"] for r in percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares).collect()}
    assert found.keys() == {(k, s) for k in values for s in shares}
    for (k, s), got in found.items():
        order = sorted(values[k])
        at = s * (len(order) - 1)
        low, high = order[int(np.floor(at))], order[int(np.ceil(at))]
        assert got == pytest.approx(low + (at - np.floor(at)) * (high - low), rel=1e-12)
    whole = percentiles(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double"), [], "v", [0.5]).collect()
    assert [tuple(r) for r in whole] == [(0.5, 2.0)]
    assert percentiles(spark.createDataFrame([], "v double"), [], "v", [0.5]).collect() == []
