"""Queries of the analytic operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import coverage, funnels, history, lattice, limits, sketches
from skein.operators.asof import asof_join
from skein.operators.frames import moving
from skein.operators.gaps import filled
from skein.operators.intervals import interval_counts, interval_join, micros
from skein.operators.ranks import percentiles, ranked, tiles
from skein.operators.scan import Running, running
from skein.sources.scratch import scratch_path

from .registry import _messages, _table, query

# --- as-of and interval joins

_OTHERS = "(SELECT x.user_id, x.ts, x.event_id AS last_event_id, x.value AS last_value, t.event_type FROM events x JOIN (SELECT DISTINCT event_type FROM events) t ON t.event_type <> x.event_type)"


@query(f"SELECT e.event_id, e.user_id, e.event_type, r.last_event_id, r.last_value FROM events e ASOF LEFT JOIN {_OTHERS} r ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.ts > r.ts")
def last_other_event(spark, d):
    """Each event with its user's last earlier event of another type: that before the first of the events of its own type
    that end with it. The event before comes by an as-of join, and is carried on from where the types differ."""
    events = _table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    before = asof_join(events, events, ["user_id"], "ts", ["event_id", "value", "event_type"], strict=True)
    other = F.when(F.col("last_event_type") != F.col("event_type"), F.struct("last_event_id", "last_value"))
    found = running(before.withColumn("other", other), ["user_id"], ["ts", "event_id"], {"carried": Running("last", "other")})
    return found.select("event_id", "user_id", "event_type", "carried.last_event_id", "carried.last_value")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o.o_orderkey AS last_o_orderkey, o.o_orderdate AS last_o_orderdate FROM (SELECT l.*, own.o_custkey FROM lineitem l JOIN orders own ON l_orderkey = own.o_orderkey) l ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON l.o_custkey = o.o_custkey AND l.l_shipdate >= o.o_orderdate")
def last_order_when_shipped(spark, d):
    """Each shipped line with its customer's last order that is not later; of orders of one day that with the largest key."""
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    found = asof_join(lines.withColumn("at", F.col("l_shipdate")), orders.withColumn("at", F.col("o_orderdate")), ["o_custkey"], "at", ["o_orderkey", "o_orderdate"], ties=["o_orderkey"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "last_o_orderkey", "last_o_orderdate")


# Events lie after the last order; a quarter of a century earlier they are among them.
_THEN = "(ts - INTERVAL 25 YEAR)"
#: Bins of times start at 2^32 microseconds, some 72 minutes.
_FINEST = 32


def _points(spark, d):
    return _table(spark, d, "events").select("event_id", "user_id", micros(F.expr(_THEN)).alias("at"))


@query(f"SELECT event_id, (SELECT count(*) FROM (SELECT min(l_shipdate) AS low, max(l_shipdate) AS high FROM lineitem GROUP BY l_orderkey) WHERE {_THEN} BETWEEN low AND high) AS n_open FROM events")
def open_orders(spark, d):
    """How many orders are open (between their first and last shipped line) at each event: counted, not paired."""
    spans = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("low"), F.max("l_shipdate").alias("high"))
    spans = spans.select(micros(F.col("low")).alias("low"), micros(F.col("high")).alias("high"))
    return interval_counts(_points(spark, d), spans, "at", "low", "high", name="n_open", finest=_FINEST).select("event_id", "n_open")


@query(f"SELECT event_id, l_orderkey, l_linenumber, l_partkey FROM events JOIN lineitem ON user_id = l_suppkey AND {_THEN} BETWEEN l_shipdate AND l_shipdate + to_days(CAST(l_quantity AS INTEGER))")
def lines_under_way(spark, d):
    """Events with the lines of the supplier of the user's number that are under way then, a day for each piece."""
    lines = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("user_id"), micros(F.col("l_shipdate")).alias("low"), (micros(F.col("l_shipdate")) + F.col("l_quantity").cast("int") * F.lit(86_400_000_000)).alias("high"))
    return interval_join(_points(spark, d), lines, "at", "low", "high", ["user_id"], _FINEST).select("event_id", "l_orderkey", "l_linenumber", "l_partkey")


# --- scans, ranks and percentiles over groups of any size

_LINE = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "cents"]
_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def _lines(spark, d):
    return _table(spark, d, "lineitem").withColumn("cents", F.expr(_CENTS)).select(*_LINE, "l_returnflag")


@query(f"SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, cents, CAST(sum(cents) OVER w AS BIGINT) AS sold, CAST(sum((l_returnflag = 'R')::INT) OVER w AS BIGINT) AS segment, max(l_quantity) OVER w AS most FROM (SELECT *, {_CENTS} AS cents FROM lineitem) WINDOW w AS (ORDER BY {', '.join(_LINE)}, l_returnflag ROWS UNBOUNDED PRECEDING)")
def running_sales(spark, d):
    """Of all lines as one group, by the day they are shipped: the sum so far, a number that grows with each return, and
    the largest quantity so far."""
    lines = _lines(spark, d).withColumn("returned", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("long"))
    found = running(lines, [], [*_LINE, "l_returnflag"], {"sold": Running("sum", "cents"), "segment": Running("sum", "returned"), "most": Running("max", "l_quantity")})
    return found.select(*_LINE, "sold", "segment", "most")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cents, ntile(100) OVER (ORDER BY cents, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS tile FROM (SELECT *, {_CENTS} AS cents FROM lineitem)")
def price_tiles(spark, d):
    """A hundred tiles of all lines, by price."""
    found = tiles(_lines(spark, d), 100, [], ["cents", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "tile")


@query("SELECT o_orderkey, o_orderpriority, o_orderdate, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS row_number, count(*) OVER (PARTITION BY o_orderpriority) AS size FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate)")
def order_ranks(spark, d):
    """Ranks of orders by date within the few priorities, of which each holds a fifth of all orders."""
    rows = _table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return ranked(rows, ["o_orderpriority"], ["o_orderdate"], ["o_orderkey"])


_SHARES = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)


@query(" UNION ALL ".join(f"SELECT l_returnflag, {s}::DOUBLE AS share, round(quantile_cont(l_extendedprice, {s}), 4) AS price FROM lineitem GROUP BY l_returnflag" for s in _SHARES))
def price_percentiles(spark, d):
    found = percentiles(_table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", _SHARES)
    return found.select("l_returnflag", "share", F.round("percentile", 4).alias("price"))


@query("SELECT conv_id AS thread_id, page, string_agg(text, '' ORDER BY turn) AS text FROM (SELECT conv_id, turn, text, CAST(floor(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 500) AS BIGINT) AS page FROM conversations) GROUP BY conv_id, page")
def transcript_pages(spark, d):
    """Transcripts in pages of about 500 characters, whatever the length of a thread."""
    return history.transcript_pages(_messages(spark, d), 500)


# --- moving aggregates

_VALUE_CENTS = "CAST(round(value * 100) AS BIGINT)"
_HOUR = 3_600_000_000


@query(f"SELECT event_id, event_type, count(*) OVER w AS n, min(value) OVER w AS least, max(value) OVER w AS most, CAST(sum({_VALUE_CENTS}) OVER w AS BIGINT) AS cents FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)")
def last_day_of_type(spark, d):
    """Each event with its type's number, least and largest value and sum over the 24 hours up to it. There are few types."""
    rows = _table(spark, d, "events").select("event_id", "event_type", "value", micros(F.col("ts")).alias("at"), F.expr(_VALUE_CENTS).alias("c"))
    found = moving(rows, ["event_type"], "at", 24 * _HOUR, 0, {"n": ("count", "event_id"), "least": ("min", "value"), "most": ("max", "value"), "cents": ("sum", "c")})
    return found.select("event_id", "event_type", "n", "least", "most", "cents")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cents, count(*) OVER w AS n, max(l_quantity) OVER w AS most, CAST(sum(cents) OVER w AS BIGINT) AS sold FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem) WINDOW w AS (ORDER BY CAST(l_shipdate AS DATE) - DATE '1970-01-01' RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def week_around_shipment(spark, d):
    """Each line with the lines shipped up to three days before or after it, of all lines as one group."""
    days = F.unix_date(F.to_date("l_shipdate")).cast("long")
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.expr(_CENTS).alias("cents"), days.alias("day"))
    found = moving(rows, [], "day", 3, 3, {"n": ("count", "day"), "most": ("max", "l_quantity"), "sold": ("sum", "cents")})
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "n", "most", "sold")


@query("WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, max(value) AS most FROM events GROUP BY ALL), d AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM b GROUP BY user_id) SELECT user_id, day, coalesce(n, 0) AS n, last_value(most IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day) AS most FROM d LEFT JOIN b USING (user_id, day)")
def user_days(spark, d):
    """Each user's days from the first event to the last: events, and the largest value of the last day that had any."""
    days = _table(spark, d, "events").groupBy("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("day")).agg(F.count("*").alias("n"), F.max("value").alias("most"))
    found = filled(days, ["user_id"], "day", ["most"])
    return found.select("user_id", F.date_from_unix_date(F.col("day").cast("int")).alias("day"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "most")


# --- waiting for a rate limit

_STEP, _BURST = 1000 * 1_000_000, 5


@query(f"WITH c AS (SELECT event_id, event_type, epoch_us(ts) AS called, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events), m AS (SELECT *, called - i * {_STEP} AS lag, max(called - i * {_STEP}) OVER (PARTITION BY event_type ORDER BY i) AS most FROM c), t AS (SELECT *, CASE WHEN lag < most THEN greatest(0, i * {_STEP} + most - {(_BURST - 1) * _STEP} - called) ELSE 0 END AS wait FROM m) SELECT event_id, event_type, called, CAST(called + ceil(wait / 100000) * 100000 AS BIGINT) AS start, CAST(ceil(wait / 100000) * 100000 AS BIGINT) AS delay FROM t")
def call_waits(spark, d):
    """When each event of a type would get through a limiter of one call in a thousand seconds, polled every 0.1 s."""
    calls = _table(spark, d, "events").select("event_id", "event_type", micros(F.col("ts")).alias("called"))
    return limits.call_starts(calls, ["event_type"], "called", ["event_id"], rate=0.001, burst=_BURST)


@query("SELECT conv_id AS slug, turn AS chapter, coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS so_far FROM conversations")
def recent_continuity(spark, d):
    rows = _table(spark, d, "conversations").select(F.col("conv_id").alias("slug"), F.col("turn").alias("chapter"), F.col("text").alias("summary"))
    return coverage.continuity(rows, most=3)


# --- sketches, cubes, funnels

_WEEKS = "(SELECT DATE '2024-01-01' AS first, DATE '2024-01-07' AS last UNION ALL SELECT DATE '2024-01-05', DATE '2024-01-25' UNION ALL SELECT DATE '2024-01-01', DATE '2024-01-31')"


@query(f"SELECT first, last, event_type, count(*) AS n, true AS distinct_within, true AS q10_within, true AS q50_within, true AS q99_within FROM events JOIN {_WEEKS} w ON CAST(ts AS DATE) BETWEEN first AND last GROUP BY ALL")
def sketched_spans(spark, d):
    """Users and values of any span of days from daily sketches; each answer is held against the exact one: the number of
    users within three standard errors, the quantiles' ranks within the error of ranks."""
    events = _table(spark, d, "events")
    path = scratch_path(spark, "sketches")
    sketches.daily(events, "ts", ["event_type"], "user_id", "value").write.partitionBy("day").parquet(path)
    wanted = spark.sql(f"SELECT * FROM {_WEEKS}")
    shares = (0.1, 0.5, 0.99)
    said = sketches.spans(spark.read.parquet(path), wanted, ["event_type"], shares)
    days = wanted.select("first", "last", F.explode(F.sequence("first", "last")).alias("day"))
    own = events.select("event_type", "user_id", "value", F.to_date("ts").alias("day")).join(days, "day")
    names = [f"q{round(100 * s)}" for s in shares]
    met = own.join(said.select("first", "last", "event_type", *names), ["first", "last", "event_type"])
    ranks = [F.sum((F.col("value") < F.col(q)).cast("long")).alias(f"{q}_below") for q in names] + [F.sum((F.col("value") <= F.col(q)).cast("long")).alias(f"{q}_at") for q in names]
    exact = met.groupBy("first", "last", "event_type").agg(F.count_distinct("user_id").alias("users"), *ranks)
    both = said.join(exact, ["first", "last", "event_type"])
    slack = F.col("n") * sketches.RANK_ERROR + 1
    within = [((F.col(f"{q}_below") <= F.col("n") * s + slack) & (F.col(f"{q}_at") >= F.col("n") * s - slack)).alias(f"{q}_within") for q, s in zip(names, shares, strict=True)]
    close = (F.abs(F.col("distinct") - F.col("users")) <= 3 * sketches.DISTINCT_ERROR * F.col("users")).alias("distinct_within")
    return both.select("first", "last", "event_type", "n", close, *within)


_DIMENSIONS = ["l_returnflag", "l_linestatus", "o_orderpriority", "c_mktsegment"]


@query(f"SELECT {', '.join(_DIMENSIONS)}, CAST(grouping({', '.join(_DIMENSIONS)}) AS INTEGER) AS grouping_id, count(*) AS n, CAST(sum({_CENTS}) AS BIGINT) AS cents, max(l_quantity) AS most, min(o_orderdate) AS first FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY CUBE ({', '.join(_DIMENSIONS)})")
def sales_cube(spark, d):
    """Four dimensions over lines, orders and customers: lineitem is read and aggregated once."""
    customers = _table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = _table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority", "o_orderdate").join(customers, "o_custkey")
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", F.expr(_CENTS).alias("cents")).join(orders, "l_orderkey")
    return lattice.cube(rows, _DIMENSIONS, {"n": ("sum", F.lit(1).cast("long")), "cents": ("sum", F.col("cents")), "most": ("max", F.col("l_quantity")), "first": ("min", F.col("o_orderdate"))})


def _funnel_sql(steps: list[str]) -> str:
    parts = ["u AS (SELECT DISTINCT user_id FROM events)"]
    for i, s in enumerate(steps, 1):
        before, later = ("u", "") if i == 1 else (f"s{i - 1}", f" AND epoch_us(e.ts) > p.step{i - 1}")
        had = "".join(f", p.step{k}" for k in range(1, i))
        parts.append(f"s{i} AS (SELECT p.user_id{had}, min(epoch_us(e.ts)) AS step{i} FROM {before} p LEFT JOIN events e ON e.user_id = p.user_id AND e.event_type = '{s}'{later} GROUP BY ALL)")
    reached = " + ".join(f"(step{i} IS NOT NULL)::INT" for i in range(1, len(steps) + 1))
    return f"WITH {', '.join(parts)} SELECT user_id, {reached} AS reached, {', '.join(f'step{i}' for i in range(1, len(steps) + 1))} FROM s{len(steps)}"


_STEPS = ["view", "click", "signup", "purchase"]


@query(_funnel_sql(_STEPS))
def user_funnels(spark, d):
    rows = _table(spark, d, "events").select("user_id", "event_type", micros(F.col("ts")).alias("at"))
    return funnels.funnel(rows, "user_id", "event_type", "at", _STEPS)
