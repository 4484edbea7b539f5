"""The stateful fold of streamed tokens into text segments; equal to operators.stream.segments over the whole stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.stream import routed

EVENTS = "session_id string, run bigint, seq bigint, mode string, node string, text string, tool_calls array<struct<name:string,args:map<string,string>>>"


def _fold(idle_millis: int | None):
    """State: the open segment's number and text. Rows of a micro-batch are put in order; batches come in order."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, text = state.get if state.exists else (0, "")
        out = []
        if state.hasTimedOut:
            state.remove()
            out += [(*key, number, text)] * bool(text)
        else:
            rows = pd.concat(list(batches)).sort_values(["seq", "cut"], ascending=[True, False])
            for cut, token in zip(rows["cut"], rows["text"], strict=True):
                if not cut:
                    text += token
                    continue
                if text:
                    out.append((*key, number, text))
                number, text = number + 1, ""
            state.update((number, text))
            if idle_millis is not None:
                state.setTimeoutDuration(idle_millis)
        yield pd.DataFrame(out, columns=["session_id", "run", "segment", "text"])

    return fold


def segments(events: DataFrame, idle_millis: int | None = None) -> DataFrame:
    """(session_id, run, segment, text) as soon as a segment ends: at a tool call, an end or an interrupt.

    What is kept for a run is its open text. With idle_millis a run that has had no event for so long ends by itself: its
    text appears and its state goes, and should it go on later, its segments are numbered from 0 again. Without, a run must
    be ended by an event for its last text to appear.
    """
    cut = F.expr("(mode = 'updates' and node = 'model' and size(tool_calls) > 0) or mode in ('end', 'interrupt')")
    rows = routed(events).withColumn("cut", F.coalesce(cut, F.lit(False))).where("cut or mode = 'messages'").select("session_id", "run", "seq", "cut", F.coalesce("text", F.lit("")).alias("text"))
    timeout = GroupStateTimeout.NoTimeout if idle_millis is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("session_id", "run").applyInPandasWithState(_fold(idle_millis), "session_id string, run bigint, segment bigint, text string", "number bigint, text string", "append", timeout)


def read_events(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run_segments(spark: SparkSession, events: str, out: str, checkpoint: str, files_a_batch: int = 100) -> None:
    """Folds what has arrived since the last run into a Parquet folder and stops. The checkpoint holds what a new process
    needs to go on: offsets and open segments."""
    query = segments(read_events(spark, events, files_a_batch)).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
