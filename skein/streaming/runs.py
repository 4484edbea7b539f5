"""Runs of a key's events, closed by the next event after a pause or, where none comes, by a timer.

State lies in RocksDB and holds an open run for each key that is active; a timer in event time closes an abandoned run and
drops its state, so nothing stays for keys that have fallen silent. Keys are held by bucket, with a list of open runs and one
timer, that of the first to end: so a micro-batch costs a few calls to the state for each bucket, not for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "key long, first long, last long, n long, total long, closed_by string"
_RUN = ["key", "first", "last", "n", "total"]


class _Runs(StatefulProcessor):
    """Times are microseconds; timers are milliseconds, rounded up. State: each open run's key, first and last time, rows,
    sum of values."""

    def __init__(self, pause: int) -> None:
        self.pause = pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", ", ".join(f"{c} long" for c in _RUN))

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in self.open.get()] if self.open.exists() else [], columns=_RUN, dtype="int64")

    def _timers(self, runs: pd.DataFrame) -> pd.Series:
        return -(-(runs["last"] + self.pause) // 1000)

    def _keep(self, runs: pd.DataFrame) -> None:
        if len(runs):
            self.open.put(list(zip(*(runs[c].tolist() for c in _RUN), strict=True)))
            self.handle.registerTimer(int(self._timers(runs).min()))
        else:
            self.open.clear()

    def _closed(self, runs: pd.DataFrame, by: str) -> pd.DataFrame:
        return runs.assign(closed_by=pd.Series(by, runs.index, dtype=object))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        if len(held):
            self.handle.deleteTimer(int(self._timers(held).min()))
        came = pd.concat(list(rows))
        came = pd.DataFrame({"key": came["key"], "first": came["at"], "last": came["at"], "n": 1, "total": came["value"]}, dtype="int64").sort_values(["key", "last"])
        parts = pd.concat([held, came], ignore_index=True).sort_values("key", kind="stable", ignore_index=True)  # a key's open run first
        of, at = parts["key"].to_numpy(), parts["last"].to_numpy()
        latest = parts.groupby("key")["last"].cummax().to_numpy()
        new = np.ones(len(parts), bool)
        new[1:] = (of[1:] != of[:-1]) | (at[1:] - latest[:-1] > self.pause)
        starts = np.flatnonzero(new)
        runs = pd.DataFrame({"key": of[starts], **{c: f.reduceat(parts[c].to_numpy(), starts) for c, f in (("first", np.minimum), ("last", np.maximum), ("n", np.add), ("total", np.add))}})
        ends = np.append(runs["key"].to_numpy()[1:] != runs["key"].to_numpy()[:-1], True)
        self._keep(runs[ends])
        yield self._closed(runs[~ends], "next")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        over = self._timers(held) < timerValues.getCurrentWatermarkInMs()
        self._keep(held[~over])
        yield self._closed(held[over], "timer")

    def close(self) -> None:
        pass


def runs(events: DataFrame, key: str, at: str, value: str, pause_seconds: int, delay: str, buckets: int = 256) -> DataFrame:
    """(key, first, last, n, total, closed_by) of each run of a key (a long): rows with no pause of more than pause_seconds
    between them, their number and the sum of a long. closed_by is next (a later row came) or timer (the watermark passed
    the end of the pause). Times are microseconds since 1970. Rows without a key or time are left out; a null value is 0.

    The stream's session must keep state in RocksDB, see replay.state_session. A micro-batch's rows of one bucket of keys are sorted in
    one task; rows that come later than the delay are dropped. The number of buckets is fixed for the life of a checkpoint.
    """
    timed = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, delay)
    rows = timed.select(F.col(key).cast("long").alias("key"), F.unix_micros(at).alias("at"), F.coalesce(F.col(value), F.lit(0)).cast("long").alias("value"), F.col(at).alias("_time"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Runs(pause_seconds * 1_000_000), SCHEMA, "append", "eventTime")
