"""A folder that all executors share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="skein-")


#: Lists of the paths given out in the scopes that are open, the innermost last.
_OPEN: list[list[str]] = []


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what was written below the scratch paths given out in it. What is read from them must be
    computed, and stored elsewhere, before."""
    _OPEN.append([])
    try:
        yield
    finally:
        delete(spark, *_OPEN.pop())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Only a session in one process, as in tests, may do without that setting and
    gets a temporary folder; on a cluster such a folder would be another one on each machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own()
    path = f"{root.rstrip('/')}/skein/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by saved() that no later step reads."""
    for df in tables:
        if path := getattr(df, "scratch", None):
            delete(df.sparkSession, path)
