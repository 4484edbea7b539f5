"""A view of totals by key that micro-batches keep up to date, in versioned Parquet.

Keys are dealt to a fixed number of buckets. A micro-batch writes new files for the buckets that its keys are in, merged
with what these held, and then a manifest: the version of each bucket's files. A version is there once its manifest is, so a
reader sees whole batches; a micro-batch that is tried again replaces its own files, and one whose manifest is there does
nothing. Older versions stay readable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a view, and so the rows of a manifest. Each bucket holds a fixed share of the keys.
BUCKETS = 64


class TotalsView:
    """Sums, and the largest and smallest values, by keys. measures says for each column of the view how it is merged (sum,
    max or min) and, as a column of the incoming rows, what goes into it."""

    _MERGE = {"sum": F.sum, "max": F.max, "min": F.min}

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], measures: dict[str, tuple[str, Column]], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.measures, self.buckets = spark, path.rstrip("/"), list(keys), measures, buckets

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def versions(self) -> list[int]:
        """Numbers of the micro-batches that the view has taken in, ascending."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []
        return sorted(int(n.removeprefix("v=")) for n in names if n.startswith("v=") and self._exists(f"{self.path}/manifest/{n}/_SUCCESS"))

    def _manifest(self, version: int) -> dict[int, int]:
        return dict(self.spark.read.parquet(f"{self.path}/manifest/v={version}").select("bucket", "version").collect())  # BUCKETS rows

    def _files(self, of: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(of.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(self._MERGE[kind](name).alias(name) for name, (kind, _) in self.measures.items()))

    def upsert(self, rows: DataFrame, number: int) -> None:
        """Takes in micro-batch number, once: of numbers that the view knows already nothing is changed. For foreachBatch."""
        known = self.versions()
        if number in known:
            return
        if known and number < known[-1]:
            raise ValueError(f"micro-batch {number} comes after {known[-1]}")
        held = self._manifest(known[-1]) if known else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        fresh = self._merged(rows.select(*self.keys, *(c.alias(n) for n, (_, c) in self.measures.items()))).withColumn("bucket", bucket)
        touched = [b for (b,) in fresh.select("bucket").distinct().collect()]  # BUCKETS rows at most
        before = self._files({b: v for b, v in held.items() if b in touched})
        whole = fresh.drop("bucket") if before is None else fresh.drop("bucket").unionByName(before)
        if touched:
            self._merged(whole).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={number}")
        manifest = held | dict.fromkeys(touched, number)
        self.spark.createDataFrame(sorted(manifest.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={number}")

    def read(self, version: int | None = None) -> DataFrame:
        """The view after a micro-batch, by default the last."""
        known = self.versions()
        of = self._manifest(known[-1] if version is None else version) if known else {}
        found = self._files(of)
        if found is None:
            raise ValueError("nothing has been taken in yet")
        return found.select(*self.keys, *self.measures)
