"""What a query does once for each row, folder or key, where tables are larger."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from skein.operators import scan
from skein.operators.intervals import interval_join
from skein.plans import registry
from skein.sources import files
from skein.streaming import replay, runs


def test_notes_lie_in_a_bounded_number_of_folders(spark, tmp_path):
    """A folder for each note was committed and listed by the driver, and one task wrote them all."""
    spark.range(2000).selectExpr("id as s_suppkey", "'name ' || id as s_name", "cast(id % 25 as int) as s_nationkey", "0D as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    folder = Path(registry._note_files(spark, str(tmp_path)).removeprefix("file://"))
    assert len(list(folder.rglob("*.txt"))) == 2000 and sum(p.is_dir() for p in folder.rglob("*")) <= 9 * 64 + 1
    expected = {i: f"# name {i}\nnation {i % 25}\n" for i in range(2000)}
    assert dict(map(tuple, registry.whole_files(spark, str(tmp_path)).collect())) == expected
    assert dict(map(tuple, registry.optional_sections(spark, str(tmp_path)).collect())) == {i: t if str(i)[0] == "1" else "" for i, t in expected.items()}


def test_documents_are_written_as_they_are(spark, tmp_path):
    rows = [("a/x.md", "one\n"), ("a/b/c d.md", ""), ("y.md", "ä\r\n "), (None, "t"), ("z.md", None)]
    files.write_documents(spark.createDataFrame(rows, "path string, text string"), f"file://{tmp_path}/out")
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes().decode() for p in (tmp_path / "out").rglob("*") if p.is_file()} == dict(rows[:3])
    assert {r["text"] for r in files.read_documents(spark, f"file://{tmp_path}/out").collect()} - {""} == {t for _, t in rows[:3] if t}


def test_interval_join_shuffles_an_interval_twice_at_most(spark):
    """Intervals were shuffled once for each bin of their covers."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        points = spark.range(100).select((F.col("id") * 10_007).alias("at"), "id")
        spans = spark.range(500).select((F.col("id") * 1_003 + 1).alias("low"), (F.col("id") * 1_003 + 90_000).alias("high"), F.col("id").alias("span"))
        found = interval_join(points, spans, "at", "low", "high")
        plan = found._jdf.queryExecution().executedPlan()
        got = {(r["id"], r["span"]) for r in found.collect()}
        written, nodes = 0, [plan]
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange":
                written += node.metrics().apply("shuffleRecordsWritten").value()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert got == {(i, s) for i in range(100) for s in range(500) if s * 1_003 + 1 <= i * 10_007 <= s * 1_003 + 90_000}
    assert 600 <= written <= 2 * 500 + 100


def test_micro_batches_are_dealt_from_one_pass(spark, tmp_path):
    """The rows were computed once for each number, by one task."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def number(i):
        seen.add(1)
        return i % 10

    replay.write_batches(spark.range(500).select("id", number("id").alias("batch")), "batch", f"{tmp_path}/in", range(10))
    assert seen.value <= 1000  # a filter and a column
    stored = spark.read.parquet(f"{tmp_path}/in").select("batch", F.input_file_name().alias("file")).groupBy("batch", "file").count()
    assert stored.orderBy("batch").select("batch", "count").collect() == [(k, 50) for k in range(10)]


def test_many_keys_share_a_bucket_of_runs(spark, tmp_path):
    """The state was asked several times for each key and micro-batch."""
    rows = spark.range(1200).selectExpr("id % 60 AS key", "timestamp_seconds(1700000000 + id * 60 + if(id >= 1140, 100000, 0)) AS ts", "id AS value", "cast(id div 400 AS int) AS batch")
    own = replay.state_session(spark)
    replay.write_batches(rows, "batch", f"{tmp_path}/in", range(3))
    found = runs.runs(replay.read_batches(own, f"{tmp_path}/in", rows.schema), "key", "ts", "value", 3600, "1 minute", buckets=2)
    replay.run(found, f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("key").select("key", "n", "total").collect()
    assert got == [(k, 19, sum(range(k, 1140, 60))) for k in range(60)]


def test_slices_become_more_with_the_rows(spark, monkeypatch):
    """Their number was the session's, so that a task's sort grew with the table."""
    monkeypatch.setattr(scan, "SLICE_ROWS", 100)
    found = scan.running(spark.range(2000).selectExpr("id", "1L AS one"), [], ["id"], {"n": scan.Running("sum", "one")})
    assert found.where("n <> id + 1").count() == 0
    files_ = found.select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files_) == 20 and max(r["count"] for r in files_) < 200
