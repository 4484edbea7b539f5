"""Gap filling against a plain loop."""

from __future__ import annotations

import random

import pytest

from skein.operators import gaps


@pytest.mark.parametrize("chunk", [1, 5, 1 << 12])
def test_filled(spark, monkeypatch, chunk):
    monkeypatch.setattr(gaps, "CHUNK", chunk)
    rnd = random.Random(11)
    places = {(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice([None, *range(-60, 60)])) for _ in range(90)} | {("one", 3)}
    rows = [(k, b, rnd.choice([None, rnd.random()]), i) for i, (k, b) in enumerate(sorted(places, key=repr))]
    df = spark.createDataFrame(rows, "k string, b long, v double, n long").repartition(4)
    found = gaps.filled(df, ["k"], "b", ["v"])
    assert found.columns == df.columns
    expected = list(rows)
    for k in {r[0] for r in rows} - {None}:
        own = {r[1]: r for r in rows if r[0] == k and r[1] is not None}
        held = None
        for b in range(min(own, default=0), max(own, default=-1) + 1):
            if b in own:
                held = own[b][2]
            else:
                expected.append((k, b, held, None))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_filled_without_keys(spark):
    df = spark.createDataFrame([(0, 1), (9_999, 2)], "b long, v long")
    found = gaps.filled(df, [], "b", ["v"])
    assert found.count() == 10_000 and found.where("b < 9999 and v = 1").count() == 9_999
    assert gaps.filled(df.limit(0), [], "b", ["v"]).collect() == []
