"""Call limits, rate limits and retries, as columns over logged calls. A null limit is no limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .scan import Running, running

#: Default limits of model and tool calls in a run; retries, factor and first delay; rate, burst.
MODEL_CALLS, TOOL_CALLS = 50, 200
RETRIES, FACTOR, FIRST_DELAY = 3, 2.0, 1.0
RATE, BURST = 25.0, 50
#: Fixed value: microseconds after which a waiting call looks for a token again.
POLL_MICROS = 100_000
#: Share of a retry's delay that jitter may add or take away.
JITTER = 0.25
#: Slots of time that far from 0 are one.
_FAR = 1 << 61


def call_status(calls: DataFrame, keys: list[str], limit: Column, order: str = "seq", at_limit: str = "end") -> DataFrame:
    """Numbers the calls of each group and says `ok`, or at_limit for those beyond the limit."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return calls.withColumn("n", n).withColumn("status", F.when(limit.isNull() | (F.col("n") <= limit), "ok").otherwise(at_limit))


def call_status_within(calls: DataFrame, run: list[str], run_limit: Column, thread: list[str], thread_limit: Column, order: list[str], at_limit: str = "end") -> DataFrame:
    """As call_status, under a limit for each run and one for the whole thread at once: the first that is reached counts."""
    n_run, n_thread = (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) for keys in (run, thread))
    within = lambda limit, n: limit.isNull() | (F.col(n) <= limit)
    counted = calls.withColumns({"n_run": n_run, "n_thread": n_thread})
    return counted.withColumn("status", F.when(within(run_limit, "n_run") & within(thread_limit, "n_thread"), "ok").otherwise(at_limit))


def retry_delays(runs: DataFrame, retries: str = "retries", factor: str = "factor", first: str = "first_delay") -> DataFrame:
    """The delay before each retry, without jitter: first * factor ^ k."""
    steps = runs.withColumn("attempt", F.explode(F.expr(f"CASE WHEN {retries} > 0 THEN sequence(0, {retries} - 1) ELSE cast(array() AS array<int>) END")))
    return steps.withColumn("delay", F.col(first) * F.pow(F.col(factor), F.col("attempt")))


def jittered(delays: DataFrame, share: float = JITTER) -> DataFrame:
    """The least and the most that a delay can be after jitter, which adds or takes away up to a share of it. The share is
    ours; the surveyed settings only switch jitter on."""
    return delays.withColumns({"least": F.col("delay") * (1 - share), "most": F.col("delay") * (1 + share)})


def calls_a_second(calls: DataFrame, keys: list[str], at: str = "ts", rate: float = RATE) -> DataFrame:
    """Calls of each group in each whole second, and whether they exceed the rate."""
    second = F.date_trunc("second", F.col(at).cast("timestamp"))
    return calls.groupBy(*keys, second.alias("second")).agg(F.count("*").alias("n")).withColumn("over", F.col("n") > rate)


def _granted(schema: StructType, rate: float, burst: float):
    """The fold over rows (key, piece, at) sorted by all three; its state is the last row's piece, time and tokens left."""

    def same(a, b) -> bool:
        return a == b or (a != a and b != b)  # Spark holds NaN as equal to itself

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, key, piece, last, left = True, None, None, 0.0, burst
        for batch in batches:
            out = []
            for k, p, now in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if first or p != piece or not same(k, key):
                    first, key, piece, left = False, k, p, burst
                else:
                    full = left + (now - last) * rate
                    left = full if full < burst else burst
                last = now
                out.append(left >= 1)
                if left >= 1:
                    left -= 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.bool_())], schema.names)

    return run


def token_bucket(calls: DataFrame, key: str, at: str = "at", rate: float = RATE, burst: float = BURST) -> DataFrame:
    """Whether each call finds a token in its group's bucket: burst tokens at first, rate more each second, burst at most.

    at is in seconds; calls without a time are left out. After burst / rate seconds without a call the bucket is full
    whatever was before, so there a group is cut into pieces that know nothing of each other. To find the cuts, time is
    dealt into slots a little longer than that: such a gap ends at the first call of a slot, and only the slot before can
    hold a call that is nearer. A piece's calls are streamed in order, with one state; only a piece, not a group, needs
    a task of its own.
    """
    rows = calls.select(F.col(key).alias("key"), F.col(at).cast("double").alias("at")).where("at is not null")
    if rate > 0 and burst > 0:
        slot = F.floor(F.col("at") / F.lit(1.01 * burst / rate))
        slot = F.when(F.isnan("at"), F.lit(_FAR)).otherwise(F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), slot)))
    else:  # a bucket that never fills
        slot = F.lit(0)
    rows = rows.withColumn("slot", slot.cast("long"))
    slots = rows.groupBy("key", "slot").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    before = slots.select(F.col("key").alias("key_before"), (F.col("slot") + 1).alias("slot_after"), F.col("high").alias("last"))
    joined = slots.join(before, F.col("key").eqNullSafe(F.col("key_before")) & (F.col("slot") == F.col("slot_after")), "left")
    cut = F.col("last").isNull() | ((F.col("low") - F.col("last")) * F.lit(float(rate)) >= F.lit(float(burst)))
    # slots of a group are as many as its time has room for, however many calls it has
    pieces = joined.select("key", "slot", F.max(F.when(cut, F.col("slot"))).over(Window.partitionBy("key").orderBy("slot")).alias("piece"))
    pieces = pieces.select(F.col("key").alias("key_of"), F.col("slot").alias("slot_of"), "piece")
    dealt = rows.join(pieces, F.col("key").eqNullSafe(F.col("key_of")) & (F.col("slot") == F.col("slot_of"))).select("key", "piece", "at")
    dealt = dealt.repartition("key", "piece").sortWithinPartitions("key", "piece", "at")
    schema = StructType([StructField("key", dealt.schema["key"].dataType), StructField("at", DoubleType()), StructField("granted", BooleanType())])
    return dealt.mapInArrow(_granted(schema, float(rate), float(burst)), schema).withColumnRenamed("key", key)


def call_starts(calls: DataFrame, keys: list[str], at: str, ties: list[str], rate: float = RATE, burst: int = BURST, poll_micros: int = POLL_MICROS) -> DataFrame:
    """The calls with start and delay (microseconds, as at is): when a call that waits for a token of its group's bucket gets
    through. Calls are served in order of at, then of ties, which should make the order total; a waiting call looks for a
    token every poll_micros. The bucket is full at first and holds burst tokens.

    With T microseconds to a token, the bucket is full again at F(i) = max(at(i), F(i-1)) + T after call i, which is
    (i + 1) T + the largest at(j) - j T of all calls j so far; call i gets its token at max(at(i), F(i-1) - (burst - 1) T). So
    two scans, of a count and of a maximum, give all starts, however long a group's queue is. Calls without a time have no
    start and take no token.
    """
    step = round(1e6 / rate)
    timed = calls.where(F.col(at).isNotNull())
    order = [at, *ties]
    counted = running(timed.withColumn("_one", F.lit(1).cast("long")), keys, order, {"_i": Running("sum", "_one")})
    ahead = running(counted.withColumn("_lag", F.col(at) - F.col("_i") * step), keys, order, {"_most": Running("max", "_lag")})
    # of the calls before: their maximum is that of all unless this call alone sets it, and then it need not wait
    full = (F.col("_i") * step) + F.col("_most")
    token = F.greatest(F.col(at), F.when(F.col("_lag") < F.col("_most"), full - (burst - 1) * step).otherwise(F.col(at) - (burst - 1) * step))
    polls = F.ceil((token - F.col(at)) / F.lit(poll_micros)).cast("long")
    out = ahead.select(*calls.columns, (F.col(at) + polls * poll_micros).alias("start"), (polls * poll_micros).alias("delay"))
    return out.unionAll(calls.where(F.col(at).isNull()).select("*", F.lit(None).cast("long"), F.lit(None).cast("long")))
