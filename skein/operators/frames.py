"""Moving aggregates over RANGE frames, for groups of any size.

A window with a RANGE frame holds a whole group in one task. Here places are cut into blocks of a frame's width, so that a
frame lies in two neighbouring blocks at most: it is a suffix of the first and a prefix of the second, or it is one block.
Prefixes and suffixes are running values within (keys, block), upwards and downwards, so minima and maxima, which cannot be
taken back out of a running value, work as sums do. The frames' ends are put in order among the values that they ask for, and
one scan (see scan.py) gives what each sees: no row is paired with another, and none goes to more than a fixed number of
places, however wide the frames are and however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import Running, running

_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def moving(rows: DataFrame, keys: Sequence[str], at: str, before: int, after: int, measures: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows, each with a column for each measure, (kind, column), over the rows with its keys whose place (at, a long)
    lies in [at - before, at + after], itself included. Kinds are sum (of longs, or of doubles up to their rounding), count,
    min and max of numbers.

    Nulls in a column add nothing: a frame without a value has the count 0 and nulls for the rest. Rows with a null key or
    place are in no frame and have nulls for all measures. Rows of one place see the same frame, and repeated rows repeat. No
    rows give none. Without keys all rows are one group.
    """
    if before < 0 or after < 0:
        raise ValueError("a frame reaches neither before nor after by less than nothing")
    for kind, _ in measures.values():
        if kind not in _MERGE:
            raise ValueError(f"{kind} is none of {', '.join(_MERGE)}")
    key, value = [f"_key{i}" for i in range(len(keys))], [f"_value{i}" for i in range(len(measures))]
    kinds = [kind for kind, _ in measures.values()]
    valid = " and ".join(f"`{c}` is not null" for c in (*keys, at))
    named = [F.col(k).alias(n) for k, n in zip(keys, key, strict=True)]
    place = F.col(at).cast("long")
    parts = [(F.count if kind == "count" else _MERGE[kind])(column).alias(n) for n, (kind, column) in zip(value, measures.values(), strict=True)]
    # rows of one place are one from here on
    places = rows.where(valid).groupBy(*named, place.alias("_at")).agg(*parts)

    width = before + after + 1
    block = lambda x: F.expr(f"({x} - pmod({x}, {width}L)) div {width}L")
    nothing = [F.lit(None).cast(places.schema[n].dataType).alias(n) for n in value]
    up, down = F.lit(False).alias("_down"), F.lit(True).alias("_down")
    first, last = f"(_at - {before}L)", f"(_at + {after}L)"
    held = places.select(*key, F.explode(F.array(up, down)).alias("_down"), block("_at").alias("_block"), "_at", *value)
    held = held.select(*key, "_down", "_block", F.expr("if(_down, -_at, _at)").alias("_pos"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_of"), *value)
    prefix = F.struct(up, block(last).alias("_block"), F.expr(last).alias("_pos"))
    suffix = F.when(block(first) < block(last), F.struct(down, block(first).alias("_block"), F.expr(f"-{first}").alias("_pos")))
    asked = places.select(*key, F.col("_at").alias("_of"), F.explode(F.array_compact(F.array(prefix, suffix))).alias("_end"))
    asked = asked.select(*key, "_end.*", F.lit(1).alias("_side"), "_of", *nothing)
    scans = {f"_run{i}": Running("sum" if kind == "count" else kind, n) for i, (kind, n) in enumerate(zip(kinds, value, strict=True))}
    # a sum counts the values it has seen too, as a sum of none is null
    sums = [n for n, kind in zip(value, kinds, strict=True) if kind == "sum"]
    seen = {f"_seen{n}": Running("sum", f"_there{n}") for n in sums}
    both = held.unionByName(asked).select("*", *(F.col(n).isNotNull().cast("long").alias(f"_there{n}") for n in sums))
    found = running(both, [*key, "_down", "_block"], ["_pos", "_side"], scans | seen).where("_side = 1")

    def merged(i: int):
        whole = _MERGE[kinds[i]](f"_run{i}")
        if kinds[i] == "sum":
            whole = F.when(F.sum(f"_seen{value[i]}") > 0, whole)
        return whole.alias(f"_found{i}")

    frames = found.groupBy(*key, "_of").agg(*(merged(i) for i in range(len(kinds))))
    own = rows.select("*", F.when(F.expr(valid), place).alias("_of"), *named)
    out = own.join(frames, [*key, "_of"], "left")
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col(f"_found{i}").alias(m) for i, m in enumerate(measures)))
