"""Specifications, plans and chapters as Markdown at fixed paths: (path, text). The surveyed project has an agent write
them by hand; these renderings are ours. Lines are put together in groups of one slug and dimension, then of one slug."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of the file names of the documents.
SPEC, PLAN = "-spec.md", "-plan.md"


def _path(folder: str, end: str) -> Column:
    return F.concat(F.lit(f"{folder}/"), "slug", F.lit(end))


def _line(text: Column) -> Column:
    """Text on one line; `not decided` where there is none."""
    return F.coalesce(F.nullif(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))), F.lit("")), F.lit("not decided"))


def spec(rows: DataFrame, folder: str) -> DataFrame:
    """A document for each slug of (slug, dim, ord, sub, choice): a heading for each dimension, by name, and below it a line
    for each choice, by ord and sub. Rows with a null slug, dim or sub are left out."""
    rows = rows.where("slug is not null and dim is not null and sub is not null")
    line = F.concat(F.lit("- **"), "sub", F.lit("**: "), _line(F.col("choice")), F.lit("\n"))
    parts = rows.withColumn("line", line).groupBy("slug", "dim").agg(F.expr("listagg(line, '') WITHIN GROUP (ORDER BY ord, sub, line)").alias("lines"))
    parts = parts.withColumn("part", F.concat(F.lit("\n## "), "dim", F.lit("\n\n"), "lines"))
    whole = parts.groupBy("slug").agg(F.expr("listagg(part, '') WITHIN GROUP (ORDER BY dim)").alias("body"))
    return whole.select(_path(folder, SPEC).alias("path"), F.concat(F.lit("# "), "slug", F.lit("\n"), "body").alias("text"))


def plan(chapters: DataFrame, folder: str) -> DataFrame:
    """A document for each slug of (slug, chapter, brief): a heading and a line for each chapter, in order."""
    rows = chapters.where("slug is not null and chapter is not null")
    part = F.concat(F.lit("\n## Chapter "), F.col("chapter").cast("string"), F.lit("\n\n"), _line(F.col("brief")), F.lit("\n"))
    whole = rows.withColumn("part", part).groupBy("slug").agg(F.expr("listagg(part, '') WITHIN GROUP (ORDER BY chapter, part)").alias("body"))
    return whole.select(_path(folder, PLAN).alias("path"), F.concat(F.lit("# "), "slug", F.lit("\n"), "body").alias("text"))


def chapters(rows: DataFrame, folder: str) -> DataFrame:
    """A document for each (slug, chapter, title, text); a null text is empty."""
    path = F.concat(F.lit(f"{folder}/"), "slug", F.lit("/chapter-"), F.lpad(F.col("chapter").cast("string"), 3, "0"), F.lit(".md"))
    return rows.where("slug is not null and chapter is not null").select(path.alias("path"), F.concat(F.lit("# "), _line(F.col("title")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))


def write(documents: DataFrame, folder: str) -> None:
    """Documents as text files, one file in a subfolder `path=...` for each, so that any of them can be read alone. A text
    without a line end at its end gets one; several texts of one path follow one another in its file."""
    lines = documents.withColumn("text", F.regexp_replace("text", r"\n\z", ""))  # the writer ends each text with a line end
    lines.repartition("path").sortWithinPartitions("path", "text").write.mode("overwrite").partitionBy("path").text(folder)


def read(spark, folder: str) -> DataFrame:
    """(path, text) of what write has written."""
    return spark.read.text(folder, wholetext=True).select(F.col("path").cast("string").alias("path"), F.col("value").alias("text"))
