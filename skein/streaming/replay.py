"""Stored rows as a stream: a file for each micro-batch, in order of arrival, and what runs a stream over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from skein.sources.scratch import delete, scratch_path

#: The state store that lies on disk beside each task, with changes in the checkpoint; timers need it.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, in at most two partitions a core: their
    number is fixed for the life of a checkpoint, and each costs something in every micro-batch."""
    own, parts = spark.newSession(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", min(parts, 2 * spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def write_batches(rows: DataFrame, batch: str, path: str, numbers: range) -> None:
    """The rows of each number, one file after the other, so that a source that takes a file at a time, the oldest first,
    has them as its micro-batches. A number without rows gives none. The rows are computed once, by all tasks, and dealt to
    folders by number; each number's file is written from its folder."""
    dealt = scratch_path(rows.sparkSession, "dealt")
    rows.where(F.col(batch).isin(*numbers)).withColumn("_number", F.col(batch).cast("int")).write.partitionBy("_number").parquet(dealt)
    stored = rows.sparkSession.read.schema(StructType([*rows.schema.fields, StructField("_number", IntegerType())])).parquet(dealt)
    for k in numbers:
        stored.where(F.col("_number") == k).drop("_number").coalesce(1).write.mode("append").parquet(path)
    delete(rows.sparkSession, dealt)


def read_batches(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream's rows to a Parquet folder until all that has arrived is worked on, the last watermark included."""
    query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return query
