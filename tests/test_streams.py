"""Streams over several micro-batches, stops and replays, against the same rows as a batch."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skein.streaming import pairs, replay, runs, views, windows

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "id long, key long, ts timestamp, value long, batch int"


def rows_of(spark, rows: list[tuple]):
    """(id, key, minutes after the start or None, value, batch)"""
    return spark.createDataFrame([(i, k, None if m is None else START + timedelta(minutes=m), v, b) for i, k, m, v, b in rows], SCHEMA)


@pytest.fixture
def own(spark):
    return replay.state_session(spark)


def stream(own, df, path: str, numbers: range):
    replay.write_batches(df, "batch", path, numbers)
    return replay.read_batches(own, path, df.schema)


def test_late_rows_are_those_that_windows_drop(spark, own, tmp_path):
    rnd = random.Random(3)
    rows = [(i, i % 3, 10 * i + (-400 if rnd.random() < 0.1 else 0), 1, i // 20) for i in range(200)] + [(900, 1, None, 1, 2)]
    live = stream(own, rows_of(spark, rows), f"{tmp_path}/in", range(10))
    replay.run(windows.windowed(live, "ts", F.window("ts", "1 hour"), "30 minutes", [], [F.count("*").alias("n")]), f"{tmp_path}/out", f"{tmp_path}/c1")
    counted = spark.read.parquet(f"{tmp_path}/out").agg(F.sum("n"), F.max("end")).first()
    for _ in range(2):  # a second run finds nothing new
        windows.late_rows(live, "ts", F.window("ts", "1 hour").getField("end"), 1800, f"{tmp_path}/side", f"{tmp_path}/c2")
    late = {r["id"] for r in windows.read_late(spark, f"{tmp_path}/side", live.schema).collect()}
    closed = rows_of(spark, rows).where(F.window("ts", "1 hour").getField("end") <= F.lit(counted[1])).select("id").collect()
    assert 0 < len(late) < 30 and counted[0] == len({r["id"] for r in closed} - late)


def test_followed_by(spark, own, tmp_path):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([1, 2, 3, None]), i * 2, rnd.randint(0, 1), i // 30) for i in range(240)] + [(999, 1, None, 0, 3)]
    df = rows_of(spark, rows)
    live = stream(own, df, f"{tmp_path}/in", range(8))
    split = lambda x: (x.where("value = 0").select("id", "key", "ts"), x.where("value = 1").select(F.col("id").alias("then_id"), "key", "ts"))
    replay.run(pairs.followed_by(*split(live), ["key"], "ts", "10 minutes", "1 minute"), f"{tmp_path}/out", f"{tmp_path}/c")
    got = {(r["id"], r["then_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {(r["id"], r["then_id"]) for r in pairs.followed_by(*split(df), ["key"], "ts", "10 minutes", "1 minute").collect()}
    assert {p for p in batch if p[1] is not None} == {p for p in got if p[1] is not None}
    missing = batch - got
    assert got <= batch and all(p[1] is None and p[0] > 225 for p in missing)  # those whose time is not up yet
    assert any(p[1] is None for p in got)


def brute_runs(rows: list[tuple], pause: int) -> list[tuple]:
    out, held = [], {}
    for _, k, m, v, _ in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: r[2]):
        if k in held and m - held[k][1] <= pause:
            held[k] = (held[k][0], m, held[k][2] + 1, held[k][3] + (v or 0))
        else:
            if k in held:
                out.append((k, *held[k]))
            held[k] = (m, m, 1, v or 0)
    return sorted(out + [(k, *h) for k, h in held.items()])


def test_runs_over_a_stop(spark, tmp_path):
    """The stream stops in the middle and goes on in another session; silent keys are closed by timers."""
    rnd = random.Random(7)
    rows = [(i, rnd.choice([1, 2, 3, 4, None]) if i < 150 else rnd.choice([1, 2]), i * 3 + rnd.randint(0, 2), rnd.choice([1, 2, None]), i // 40) for i in range(320)]
    rows += [(1000 + i, 9, 2000 + 100 * i, 1, 8) for i in range(3)]  # far ahead: all other runs are abandoned
    df = rows_of(spark, rows)
    paths = [f"{tmp_path}/{x}" for x in ("in", "out", "check")]
    for numbers in (range(4), range(4, 9)):
        live = stream(replay.state_session(spark), df, paths[0], numbers)
        replay.run(runs.runs(live, "key", "ts", "value", 600, "5 minutes"), *paths[1:])
    got = spark.read.parquet(paths[1]).collect()
    micro = lambda m: round((START + timedelta(minutes=m)).timestamp() * 1e6)
    expected = [(k, micro(a), micro(b), n, t) for k, a, b, n, t in brute_runs(rows, 10) if not (k == 9 and a == 2200)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected)
    by = {c: {r["key"] for r in got if r["closed_by"] == c} for c in ("next", "timer")}
    assert {3, 4} <= by["timer"] and by["next"]


def test_view_takes_in_each_batch_once(spark, tmp_path):
    rows = [(i, i % 7, i, i, i // 25) for i in range(100)]
    df = rows_of(spark, rows)
    view = views.TotalsView(spark, f"{tmp_path}/v", ["key"], {"n": ("sum", F.lit(1).cast("long")), "top": ("max", F.col("value")), "low": ("min", F.col("value"))}, buckets=4)
    with pytest.raises(ValueError):
        view.read()
    expected = lambda upto: sorted((k, len(v), max(v), min(v)) for k, v in {k: [r[3] for r in rows if r[1] == k and r[4] <= upto] for k in range(7)}.items() if v)
    for b in range(4):
        view.upsert(df.where(F.col("batch") == b), b)
        view.upsert(df.where(F.col("batch") == b), b)
        assert sorted(map(tuple, view.read().collect())) == expected(b)
    assert sorted(map(tuple, view.read(1).collect())) == expected(1)  # older versions stay
    with pytest.raises(ValueError):
        view.upsert(df, -1)
    # a try that failed before its manifest leaves files, which the next try replaces
    df.limit(5).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{tmp_path}/v/data/v=9")
    view.upsert(df.where("batch = 0"), 9)
    assert {r["key"]: r["n"] for r in view.read().collect()} == {k: len([r for r in rows if r[1] == k]) + len([r for r in rows if r[1] == k and r[4] == 0]) for k in range(7)}
    view.upsert(df.limit(0), 10)
    assert view.versions() == [0, 1, 2, 3, 9, 10] and view.read().count() == 7


def test_an_abandoned_run_of_tokens_ends_by_itself(spark, tmp_path):
    import time

    from skein.streaming import segments as live

    row = lambda seq, mode, text: ("s", 1, seq, mode, "model" if mode == "messages" else None, text, None)
    spark.createDataFrame([row(1, "messages", "one"), row(2, "end", None), row(3, "messages", "left "), row(4, "messages", "open")], live.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    found = live.segments(live.read_events(spark, f"{tmp_path}/in"), idle_millis=1000)
    query = found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start(f"{tmp_path}/out")
    schema, until = "session_id string, run bigint, segment bigint, text string", time.time() + 60
    rows = []
    while len(rows) < 2 and time.time() < until:
        time.sleep(1)
        if (tmp_path / "out" / "_spark_metadata").exists():
            rows = sorted(map(tuple, spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()))
    query.stop()
    assert rows == [("s", 1, 0, "one"), ("s", 1, 1, "left open")]
