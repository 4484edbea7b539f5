"""Windows over event time with a watermark, and the rows that come too late for them.

A window closes once the watermark (the latest event time of the micro-batches before, less the delay) reaches its end: its
row is appended and its state goes, so what is kept is bounded by the windows that are open. Rows for closed windows are
dropped by Spark without a word; late_rows keeps them in a table of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's late rows of a micro-batch are those behind the watermark with which the batch before it closed windows, which
#: comes from the batches before that one.
BATCHES_BEHIND = 2


def windowed(events: DataFrame, at: str, window: Column, delay: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates by window and keys: (start, end, keys, aggregates). window is F.window (tumbling or sliding) or
    F.session_window over at. Of a stream, rows of closed windows; of a table, of all its windows, as a batch has no
    watermark. Rows without a time are left out."""
    timed = events.where(F.col(at).isNotNull()).withWatermark(at, delay)
    found = timed.groupBy(window.alias("window"), *keys).agg(*aggregates)
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(c for c in found.columns if c != "window"))


def late_rows(stream: DataFrame, at: str, end: Column, delay_seconds: int, out: str, checkpoint: str) -> None:
    """Writes to out, by micro-batch, the rows of the stream whose window (that ends at end) was closed when they came, as
    windowed() over the same micro-batches drops them.

    Each micro-batch writes its latest event time and its late rows below its number, and replaces what a failed try has
    left there: a replay changes nothing.
    """
    marks, late = f"{out}/marks", f"{out}/late"
    jvm = stream.sparkSession._jvm

    def keep(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        folder = jvm.org.apache.hadoop.fs.Path(marks)
        before = None
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            seen = spark.read.schema("latest timestamp, batch long").parquet(marks)  # a row for each micro-batch
            before = seen.where(F.col("batch") <= number - BATCHES_BEHIND).agg(F.max("latest")).first()[0]
        rows.agg(F.max(at).alias("latest")).write.mode("overwrite").parquet(f"{marks}/batch={number}")
        mark = F.date_trunc("millisecond", F.lit(before).cast("timestamp")) - F.make_dt_interval(secs=F.lit(delay_seconds))
        rows.where(F.col(at).isNotNull() & F.coalesce(end <= mark, F.lit(False))).write.mode("overwrite").parquet(f"{late}/batch={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_late(spark: SparkSession, out: str, schema) -> DataFrame:
    """The late rows that late_rows has kept."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/late")
