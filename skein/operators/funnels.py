"""Funnels as a table function with a partitioned table argument: rows of a key come in order and are not gathered."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _handler(steps: Sequence[str]):
    class Funnel:
        """State: how many steps have been reached, and when. A batch is searched for the next step's first row, which numpy
        finds; what is kept of a key is one time for each step."""

        def __init__(self) -> None:
            self.key, self.times = None, []

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            if rows.num_rows:
                self.key = rows.column(0)[0]
                kinds, at = np.array(rows.column(1)), np.array(rows.column(2))
                start = 0
                while len(self.times) < len(steps):
                    able = kinds[start:] == steps[len(self.times)]
                    if self.times:
                        able &= at[start:] > self.times[-1]
                    hit = np.flatnonzero(able)
                    if not len(hit):
                        break
                    start += int(hit[0])
                    self.times.append(int(at[start]))
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            if self.key is not None:
                times = [*self.times, *[None] * (len(steps) - len(self.times))]
                yield pa.table({"key": pa.array([self.key.as_py()], pa.int64()), "reached": pa.array([len(self.times)], pa.int32()), **{f"step{i}": pa.array([t], pa.int64()) for i, t in enumerate(times, 1)}})

    return Funnel


def funnel(events: DataFrame, key: str, kind: str, at: str, steps: Sequence[str]) -> DataFrame:
    """(key, reached, step1, step2, ...) for each key (a long): how many of the steps its events reach one after the other,
    and when: each step is the first event of its kind later than the step before. at is a long. The columns follow from
    the steps. Events with a null key, kind or time take no part."""
    schema = "key bigint, reached int, " + ", ".join(f"step{i} bigint" for i in range(1, len(steps) + 1))
    table = F.arrow_udtf(_handler(list(steps)), returnType=schema)
    rows = events.where(F.col(key).isNotNull() & F.col(kind).isNotNull() & F.col(at).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(kind).alias("kind"), F.col(at).cast("long").alias("at"))
    return table(rows.asTable().partitionBy("key").orderBy("at")).withColumnRenamed("key", key)
