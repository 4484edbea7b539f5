"""The token bucket over more calls of a key than one array should hold."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from skein.operators import limits


def folded(rows: list[tuple], rate: float, burst: float) -> list[tuple]:
    groups, out = defaultdict(list), []
    for key, at in rows:
        groups[key].append(at)
    for key, times in groups.items():
        left, last = burst, None
        for now in sorted(times):
            if last is not None:
                left = min(burst, left + (now - last) * rate)
            last = now
            out.append((key, now, left >= 1))
            left -= left >= 1
    return sorted(out, key=repr)


@pytest.mark.parametrize(("rate", "burst"), [(2.0, 3.0), (0.25, 5.0), (1000.0, 50.0), (0.0, 4.0), (1.0, 0.5)])
def test_token_bucket_is_the_fold(spark, rate, burst):
    """Ties, gaps just at, below and above burst / rate, negative times, a null key."""
    rnd, rows = random.Random(3), []
    for key in ("a", "b", None):
        now = -50.0
        for _ in range(400):
            now += rnd.choice([0.0, 0.1, 0.25, 1.0, 1.4999, 1.5, 1.51, 3.0, 19.9, 20.0, 20.1, 90.0])
            rows.append((key, now))
    rnd.shuffle(rows)
    found = limits.token_bucket(spark.createDataFrame(rows, "k string, at double").repartition(5), "k", rate=rate, burst=burst).collect()
    assert sorted(((r["k"], r["at"], r["granted"]) for r in found), key=repr) == folded(rows, rate, burst)


def test_token_bucket_gathers_no_group(spark):
    """A key with many calls and no pause is streamed; with pauses its pieces are dealt over tasks."""
    n = 60_000
    calls = spark.range(n).selectExpr("'k' AS k", "id * 0.01D + 30 * floor(id / 1000) AS at")
    found = limits.token_bucket(calls, "k", rate=25, burst=50)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = [(r["k"], r["at"]) for r in calls.collect()]
    assert sorted(map(tuple, found.collect()), key=repr) == folded(rows, 25.0, 50.0)
    assert limits.token_bucket(calls.limit(0), "k").count() == 0
