"""Queries of the streaming operators: the events table replayed in ten micro-batches, with SQL over the whole of it.

Where events may be late, those of the largest values come three micro-batches after their time. SQL knows the watermark of
each micro-batch as the latest time of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.scratch import scratch_path
from skein.streaming import pairs, replay, runs, views, windows

from .registry import _table, query

BATCHES, DELAY = range(10), 3600
_OWN = "CAST(floor(event_id * 10 / CAST((SELECT max(event_id) + 1 FROM {events}) AS DOUBLE)) AS INT)"
_LATE = f"least(9, {_OWN} + CASE WHEN value > 90 THEN 3 ELSE 0 END)"
# late by so much that no window of theirs can still be open
_LOST = f"{_OWN} + CASE WHEN value > 90 AND {_OWN} <= 6 THEN 3 ELSE 0 END"
_MICROS = "epoch_us(ts)"


def _stream(spark: SparkSession, d: str, batch: str) -> DataFrame:
    """events as a stream in micro-batches, with ts as a timestamp and cents of the value as a long."""
    path = scratch_path(spark, "arrivals")
    table = f"parquet.`{d}/events.parquet`"
    rows = spark.sql(f"SELECT event_id, cast(ts as timestamp) AS ts, user_id, event_type, cast(round(value * 100) as bigint) AS cents, {batch.format(events=table)} AS batch FROM {table}")
    replay.write_batches(rows, "batch", path, BATCHES)
    return replay.read_batches(replay.state_session(spark), path, rows.schema)


def _out(spark: SparkSession, rows: DataFrame) -> DataFrame:
    out = scratch_path(spark, "stream")
    replay.run(rows, out, scratch_path(spark, "checkpoint"))
    return spark.read.schema(rows.schema).parquet(out)


def _plain(rows: DataFrame, *names: str) -> DataFrame:
    """Timestamps without zone, as the table's are."""
    return rows.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def _arrived(batch: str) -> str:
    return f"(SELECT *, {batch.format(events='events')} AS batch FROM events)"


def _marks(batch: str) -> str:
    return f"(SELECT b AS batch, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {DELAY} SECOND FROM {_arrived(batch)} WHERE batch <= b - {windows.BATCHES_BEHIND}) AS mark FROM (SELECT unnest(range(10)) AS b))"


_ARRIVED, _MARKS = _arrived(_LATE), _marks(_LATE)
_LAST = f"(SELECT date_trunc('millisecond', max(ts)) - INTERVAL {DELAY} SECOND FROM events)"
_HOURS = "epoch_us(ts) // 3600000000"
_WINDOW = "make_timestamp(({h}) * 3600000000)"


def _windows_sql(hours: str, size: int, keys: str) -> str:
    """hours: the windows' first hours for a row, as a list."""
    start = _WINDOW.format(h="h")
    return f"SELECT start, start + INTERVAL {size} HOUR AS \"end\", {keys}, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM (SELECT a.*, {start} AS start FROM (SELECT *, unnest({hours}) AS h FROM {_ARRIVED}) a) x JOIN {_MARKS} USING (batch) WHERE (mark IS NULL OR start + INTERVAL {size} HOUR > mark) AND start + INTERVAL {size} HOUR <= {_LAST} GROUP BY ALL"


def _counts():
    return [F.count("*").alias("n"), F.sum("cents").alias("cents")]


@query(_windows_sql(f"[({_HOURS}) // 6 * 6]", 6, "event_type"))
def streamed_tumbling_windows(spark, d):
    """Six hours at a time by type; rows for closed windows are left out."""
    return _plain(_out(spark, windows.windowed(_stream(spark, d, _LATE), "ts", F.window("ts", "6 hours"), f"{DELAY} seconds", ["event_type"], _counts())), "start", "end")


@query(_windows_sql(f"[({_HOURS}) // 8 * 8, ({_HOURS}) // 8 * 8 - 8, ({_HOURS}) // 8 * 8 - 16]", 24, "event_type"))
def streamed_sliding_windows(spark, d):
    """A day at a time, every eight hours."""
    return _plain(_out(spark, windows.windowed(_stream(spark, d, _LATE), "ts", F.window("ts", "24 hours", "8 hours"), f"{DELAY} seconds", ["event_type"], _counts())), "start", "end")


@query(f"WITH k AS (SELECT a.* FROM {_arrived(_LOST)} a JOIN {_marks(_LOST)} USING (batch) WHERE mark IS NULL OR ts + INTERVAL 12 HOUR > mark), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR, true))::INT AS new FROM k)), w AS (SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS \"end\", user_id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM s GROUP BY user_id, session) SELECT * FROM w WHERE \"end\" <= {_LAST}")
def streamed_session_windows(spark, d):
    """Sessions of a user, ended by twelve hours without an event. Late rows come three micro-batches after their time here:
    one that came while its own session was closed, but its window not, would make a session of its own."""
    return _plain(_out(spark, windows.windowed(_stream(spark, d, _LOST), "ts", F.session_window("ts", "12 hours"), f"{DELAY} seconds", ["user_id"], _counts())), "start", "end")


@query(f"SELECT event_id, event_type, ts FROM {_ARRIVED} JOIN {_MARKS} USING (batch) WHERE make_timestamp(({_HOURS}) // 6 * 6 * 3600000000) + INTERVAL 6 HOUR <= mark")
def streamed_late_rows(spark, d):
    """The rows that streamed_tumbling_windows leaves out."""
    stream, out = _stream(spark, d, _LATE), scratch_path(spark, "late")
    windows.late_rows(stream, "ts", F.window("ts", "6 hours").getField("end"), DELAY, out, scratch_path(spark, "checkpoint"))
    return _plain(windows.read_late(spark, out, stream.schema).select("event_id", "event_type", "ts"), "ts")


_PAIRED = "SELECT l.event_id, l.user_id, l.ts, r.event_id AS then_event_id, r.ts AS then_ts FROM (SELECT * FROM events WHERE event_type = 'view') l LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON r.user_id = l.user_id AND r.ts >= l.ts AND r.ts <= l.ts + INTERVAL 12 HOUR"


@query(f"SELECT * FROM ({_PAIRED}) WHERE then_event_id IS NOT NULL OR ts + INTERVAL 12 HOUR < (SELECT min(t) - INTERVAL {DELAY} SECOND FROM (SELECT date_trunc('millisecond', max(ts)) AS t FROM events WHERE event_type IN ('view', 'purchase') GROUP BY event_type))")
def streamed_followers(spark, d):
    """Views with the purchases of the same user within twelve hours; one without any appears once both watermarks are past
    that time."""
    stream = _stream(spark, d, _OWN).select("event_id", "user_id", "ts", "event_type")
    views_, bought = (stream.where(F.col("event_type") == k).drop("event_type") for k in ("view", "purchase"))
    found = pairs.followed_by(views_, bought.withColumnRenamed("event_id", "then_event_id"), ["user_id"], "ts", "12 hours", f"{DELAY} seconds")
    return _plain(_out(spark, found), "ts", "then_ts")


@query(f"WITH s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM (SELECT *, (coalesce({_MICROS} - lag({_MICROS}) OVER (PARTITION BY user_id ORDER BY ts) > 43200000000, true))::INT AS new FROM events)), w AS (SELECT user_id AS key, min({_MICROS}) AS first, max({_MICROS}) AS last, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM s GROUP BY user_id, run), b AS (SELECT w.*, lead(first) OVER (PARTITION BY key ORDER BY first) AS next FROM w) SELECT key, first, last, n, total FROM b WHERE next IS NOT NULL OR last + 43200000000 < epoch_us({_LAST})")
def streamed_runs(spark, d):
    """Runs of a user's events, ended by twelve hours of silence. The stream stops after half of the micro-batches and goes
    on from its checkpoint in another session."""
    arrivals, out, checkpoint = (scratch_path(spark, x) for x in ("arrivals", "runs", "checkpoint"))
    table = f"parquet.`{d}/events.parquet`"
    rows = spark.sql(f"SELECT user_id, cast(ts as timestamp) AS ts, cast(round(value * 100) as bigint) AS cents, {_OWN.format(events=table)} AS batch FROM {table}")
    for half in (range(5), range(5, 10)):
        replay.write_batches(rows, "batch", arrivals, half)
        own = replay.state_session(spark)
        replay.run(runs.runs(replay.read_batches(own, arrivals, rows.schema), "user_id", "ts", "cents", 43_200, f"{DELAY} seconds"), out, checkpoint)
    return spark.read.schema(runs.SCHEMA).parquet(out).drop("closed_by")


@query(f"SELECT b AS version, user_id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, max(ts) AS latest FROM (SELECT *, {_LATE.format(events='events')} AS batch FROM events) JOIN (SELECT unnest(range(10)) AS b) ON batch <= b GROUP BY ALL")
def streamed_totals(spark, d):
    """Totals of users, kept up to date by micro-batches, after each of them. Every third one is taken in twice."""
    stream = _stream(spark, d, _LATE)
    view = views.TotalsView(spark, scratch_path(spark, "view"), ["user_id"], {"n": ("sum", F.lit(1).cast("long")), "cents": ("sum", F.col("cents")), "latest": ("max", F.col("ts"))}, buckets=16)

    def take_in(rows: DataFrame, number: int) -> None:
        for _ in range(2 if number % 3 == 0 else 1):
            view.upsert(rows, number)

    stream.writeStream.foreachBatch(take_in).option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    found = None
    for v in view.versions():
        rows = view.read(v).select(F.lit(v).cast("int").alias("version"), "*")
        found = rows if found is None else found.unionAll(rows)
    return _plain(found, "latest")
