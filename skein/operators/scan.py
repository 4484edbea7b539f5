"""Running values over groups of any size: a prefix scan over range partitions.

A window holds a whole group in one task. Here rows are range-partitioned by (keys, order), so that a group with most of
the rows is dealt over as many tasks as its rows need; each task streams its slice in order and computes running values
from the slice's start. What a slice adds is a row: the values at its end. The exclusive scan over these rows, one for each
slice, gives what each slice starts with; only the rows of a slice's first group still need it, as all other groups of the
slice begin in it. The slices are a table in the shared folder, as their bounds come from a sample and must not change
between the two looks at them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, LongType, StructField, StructType

from skein.sources.scratch import saved

KINDS = ("sum", "max", "min", "last")

#: Rows that a slice has, about, where there are more than the cores take at once.
SLICE_ROWS = 500_000


@dataclass(frozen=True)
class Running:
    """A running value of a column, up to and with each row: sum (of longs or doubles; 0 before the first value), max, min
    (of numbers) or last (of any type: the last value that is not null). Nulls add nothing; max, min and last are null
    before the first value."""

    kind: str
    column: str

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"{self.kind} is none of {', '.join(KINDS)}")


def _changes(batch: pa.RecordBatch, keys: Sequence[str], last: tuple | None) -> np.ndarray:
    """Flags the rows whose keys differ from those of the row before; the first is held against last."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        code = np.array(batch.column(k).dictionary_encode(null_encoding="encode").indices)
        new[1:] |= code[1:] != code[:-1]
    new[0] = last is None or last != tuple(batch.column(k)[0].as_py() for k in keys)
    return new


class _State:
    """The running value of one measure over the batches of a slice."""

    def __init__(self, kind: str, type_: pa.DataType) -> None:
        self.kind, self.type, self.held = kind, type_, pa.scalar(0 if kind == "sum" else None, type_)

    def over(self, column: pa.Array, new: np.ndarray) -> pa.Array:
        """The running values of a batch; new flags the starts of groups."""
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        goes_on = np.cumsum(new) == 0  # rows of the group that began in a batch before
        if self.kind == "sum":
            values = np.array(column.fill_null(0))
            total = np.cumsum(values)
            out = pa.array(total - (total - values)[head] + np.where(goes_on, self.held.as_py(), 0), self.type)
        elif self.kind == "last":
            at = np.maximum.accumulate(np.where(np.array(column.is_valid()), np.arange(len(column)), -1))
            there = at >= head
            place = np.where(there, at + 1, 0)
            out = pa.concat_arrays([pa.array([self.held.as_py()], self.type), column.cast(self.type)]).take(pa.array(place, mask=~there & ~goes_on))
        else:
            start = pd.Series([self.held.as_py()]).astype("Int64" if pa.types.is_integer(self.type) else "Float64")
            series = pd.concat([start, column.to_pandas(integer_object_nulls=True).astype(start.dtype)], ignore_index=True)
            group = np.append(0, np.cumsum(new))
            by = series.groupby(group)
            run = (by.cummax() if self.kind == "max" else by.cummin()).groupby(group).ffill()[1:]
            out = pa.array(run, self.type, from_pandas=True)
        self.held = out[len(out) - 1]
        return out


def _local(keys: Sequence[str], measures: dict[str, Running]):
    """Running values from the slice's start, the place in the slice, and whether the row is of the slice's first group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, last, first, states = uuid.uuid4().hex, 0, None, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if states is None:
                states = {m: _State(r.kind, batch.column(r.column).type) for m, r in measures.items()}
            new = _changes(batch, keys, last)
            last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
            head = np.full(batch.num_rows, first) & (np.cumsum(new) - (at == 0) == 0)
            first = bool(head[-1])
            extra = [states[m].over(batch.column(r.column), new) for m, r in measures.items()]
            place = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra, pa.array([name] * batch.num_rows), pa.array(place), pa.array(head)], [*batch.schema.names, *measures, "_slice", "_place", "_head"])

    return run


def _before(kind: str, held, value):
    """What is held and what comes after it, as one."""
    if kind == "last":
        return held if value is None else value
    if held is None or value is None:
        return value if held is None else held
    return held + value if kind == "sum" else (max if kind == "max" else min)(held, value)


def _dealt(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows by range: many of them in slices of a given number, which are not coalesced."""
    slices = -(-rows.count() // SLICE_ROWS)
    return rows.repartitionByRange(slices, *by) if slices > rows.sparkSession.sparkContext.defaultParallelism else rows.repartitionByRange(*by)


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], measures: dict[str, Running]) -> DataFrame:
    """The rows with a column for each measure: its running value within the group of the keys, in ascending order (nulls
    first, as Spark sorts). Without keys all rows are one group.

    Rows that are equal in keys and order come in any order, so the order should be total; a group whose rows are all equal
    in it can't be dealt out. No rows give none. One range shuffle, one table, and a broadcast of a row for each slice. The
    rows are counted first, so that slices become more with them, and not larger.
    """
    by = [*keys, *order]
    dealt = _dealt(rows, by).sortWithinPartitions(*by) if by else rows
    kinds: dict[str, DataType] = {m: rows.schema[r.column].dataType for m, r in measures.items()}
    fields = [StructField(m, t) for m, t in kinds.items()]
    schema = StructType([*rows.schema.fields, *fields, StructField("_slice", rows.select(F.lit("")).schema[0].dataType), StructField("_place", LongType()), StructField("_head", BooleanType())])
    table = saved(dealt.mapInArrow(_local(keys, measures), schema), "slices")

    ends = F.struct(*keys, *measures, "_head")
    edges = table.groupBy("_slice").agg(F.min_by(F.struct(*by), "_place").alias("low"), F.max_by(ends, "_place").alias("end"))
    started = []
    key_of = lambda row: tuple(row[k] for k in keys)
    held = None  # the last group so far, and its values
    for low, end, name in edges.orderBy("low").select("low", "end", "_slice").toLocalIterator():
        carried = held[1] if held and held[0] == key_of(low) else None
        if carried:
            started.append((name, *carried))
        values = [end[m] for m in measures]
        if carried and end["_head"]:
            values = [_before(r.kind, c, v) for r, c, v in zip(measures.values(), carried, values, strict=True)]
        held = key_of(end), values
    known = rows.sparkSession.createDataFrame(started, StructType([StructField("_slice", schema["_slice"].dataType), *(StructField(f"_start_{m}", t) for m, t in kinds.items())]))

    def whole(m: str, kind: str):
        own, start = F.col(m), F.col(f"_start_{m}")
        if kind == "sum":
            both = own + F.coalesce(start, F.lit(0).cast(kinds[m]))
        else:
            both = F.coalesce(own, start) if kind == "last" else (F.greatest if kind == "max" else F.least)(own, start)
        return F.when(F.col("_head"), both).otherwise(own).alias(m)

    # a row for each slice at most
    return table.join(F.broadcast(known), "_slice", "left").select(*rows.columns, *(whole(m, r.kind) for m, r in measures.items()))
