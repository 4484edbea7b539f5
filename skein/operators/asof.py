"""As-of join: each row with the last row of another table that is not later, by a scan that carries it on.

Both tables' rows are put in one order by key and time; the last row of the right side is carried over time slices (see
scan.py), so that a key with most of the rows is dealt over tasks. Neither side is paired with the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import Running, running


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: Sequence[str], ties: Sequence[str] = (), strict: bool = False, prefix: str = "last_") -> DataFrame:
    """The rows of left, each with the value columns, under the prefix, of the last row of right with its keys and a time
    not later than its own (earlier, if strict).

    Both have the keys and at. Of rows of right at one time the last by the columns ties counts, then by value. Rows of left
    without such a row have nulls, as have those with a null key or time; rows of right with a null in either are no one's
    last. Repeated rows of left repeat.
    """
    names = [f"{prefix}{v}" for v in value]
    order = ["_at", "_side", *(f"_tie{i}" for i in range(len(ties) + len(value)))]
    key = [f"_key{i}" for i in range(len(keys))]
    valid = " and ".join(f"{c} is not null" for c in (*keys, at))
    found = F.struct(*(F.col(v).alias(n) for v, n in zip(value, names, strict=True)))
    kind = right.select(found.alias("x")).schema["x"].dataType
    kept = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(left.columns)))
    tie_kinds = [right.schema[c].dataType for c in (*ties, *value)]
    placed = lambda rows: rows.where(valid).select(*(F.col(k).alias(n) for k, n in zip(keys, key, strict=True)), F.col(at).alias("_at"), "*")
    # at one time, a strict join has left's rows before right's
    ours = placed(left).select(*key, "_at", F.lit(0 if strict else 1).alias("_side"), *(F.lit(None).cast(t).alias(n) for t, n in zip(tie_kinds, order[2:], strict=True)), kept.alias("_row"), F.lit(None).cast(kind).alias("_found"))
    theirs = placed(right).select(*key, "_at", F.lit(1 if strict else 0).alias("_side"), *(F.col(c).alias(n) for c, n in zip((*ties, *value), order[2:], strict=True)), F.lit(None).cast(ours.schema["_row"].dataType).alias("_row"), found.alias("_found"))
    merged = running(ours.unionAll(theirs), key, order, {"_last": Running("last", "_found")}).where("_row is not null")
    columns = [F.col(f"_row.c{i}").alias(c) for i, c in enumerate(left.columns)]
    out = merged.select(*columns, *(F.col(f"_last.{n}").alias(n) for n in names))
    rest = left.where(f"not ({valid})").select("*", *(F.lit(None).cast(kind[n].dataType).alias(n) for n in names))
    return out.unionAll(rest)
