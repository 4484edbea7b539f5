"""Gap filling: a row for each bucket between a group's first and last, with what was last known carried into it.

What stands before a gap comes by an as-of join of the buckets with themselves, so a group of any size is dealt over tasks; a
gap is then filled where it ends, without a calendar that all groups are joined with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import asof_join

#: Buckets of a gap that one array holds; a longer gap is several.
CHUNK = 1 << 12


def filled(buckets: DataFrame, keys: Sequence[str], bucket: str, carried: Sequence[str] = ()) -> DataFrame:
    """The rows, one for each group and bucket (a long), and one for each bucket that a group lacks between its first and its
    last. Such a row has the values of the group's bucket before it in the carried columns (a null stays one), and nulls in
    the others. Rows with a null key or bucket are kept as they are and no gap begins or ends in them. No rows give none.
    """
    last, own = f"_last_{bucket}", [*keys, bucket]
    known = asof_join(buckets.select(*own), buckets.select(*own, *carried), keys, bucket, [bucket, *carried], strict=True, prefix="_last_")
    gaps = known.where(F.col(last) + 1 < F.col(bucket))
    some = gaps.select("*", F.explode(F.expr(f"sequence(`{last}` + 1, `{bucket}` - 1, {CHUNK}L)")).alias("_start"))
    each = some.withColumn(bucket, F.explode(F.expr(f"sequence(_start, least(_start + {CHUNK - 1}L, `{bucket}` - 1))")))
    return buckets.unionByName(each.select(*own, *(F.col(f"_last_{c}").alias(c) for c in carried)), allowMissingColumns=True)
