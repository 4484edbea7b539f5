"""Rules that the SQL comparison does not show: plain-Python models, properties, files and the streamed fold."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import content as C
from skein.operators import config, docs, history, limits, render, stream
import fixtures as X
from skein.sources import files, sessions
from skein.streaming import segments as live


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="a -\n\t  \u0085\x1c\x1d\x1e\x1f\x0b\x0c\r", max_size=12), min_size=1, max_size=20))
def test_strip_is_that_of_python(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.strip(F.col("t")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in rows} == {i: t.strip() for i, t in enumerate(texts)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="-\na: ", max_size=30).map(lambda t: "---\n" + t), min_size=1, max_size=20))
def test_front_matter_is_that_of_python(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.strip_front_matter(F.col("t")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in rows} == {i: re.sub(r"\A---\n.*?\n---\n", "", t, count=1, flags=re.DOTALL).strip() for i, t in enumerate(texts)}


def test_new_identifiers(spark):
    ids = [r["u"] for r in spark.range(500).select(C.uuid7().alias("u")).collect()]
    assert len(set(ids)) == 500 and all(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", u) for u in ids)


def test_banner_counts_what_is_not_shown(spark):
    rows = [("t", 1, "system", '"s"'), ("t", 2, "human", '"  "'), ("t", 3, "ai", '[{"type":"text","text":"hi"}]'), ("t", 4, "tool", '"x"')]
    messages = spark.createDataFrame(rows, "thread_id string, seq int, type string, raw string").select("thread_id", "seq", "type", F.parse_json("raw").alias("content"))
    assert [tuple(r) for r in history.replay(messages).collect()] == [("t", 3, "saga>", "hi", 4)]
    assert [r["seq"] for r in history.thread(messages, "t").collect()] == [1, 2, 3, 4]


def test_streamed_fold_equals_batch(spark, tmp_path):
    """Segments reach over micro-batches of a few events, and over two runs of the query."""
    events = X.frame(spark, X.TOOL_CALLS, live.EVENTS)
    paths = [str(tmp_path / x) for x in ("in", "out", "check")]
    for a, b in ((1, 2), (3, 6), (7, 10), (11, 13)):
        events.where(F.col("seq").between(a, b)).coalesce(1).write.mode("append").parquet(paths[0])
        if b in (6, 13):
            live.run_segments(spark, *paths, files_a_batch=1)
    got = {tuple(r) for r in spark.read.parquet(paths[1]).collect()}
    assert got == {tuple(r) for r in stream.segments(events).collect()} and len(got) == 4


def test_token_bucket(spark):
    at = [0.0] * 4 + [0.5, 1.0, 1.0]
    rows = limits.token_bucket(spark.createDataFrame([("k", t) for t in at], "k string, at double"), "k", rate=1, burst=3).collect()
    assert [r["granted"] for r in rows] == [True, True, True, False, False, True, False]


def test_sources(spark, tmp_path):
    assert sessions.scan_sessions(spark, str(tmp_path)).count() == 0
    (tmp_path / "sessions" / "b").mkdir(parents=True)
    (tmp_path / "sessions" / "a").mkdir()
    (tmp_path / "sessions" / "note.txt").write_text("x")
    assert [r["session_id"] for r in sessions.list_sessions(sessions.scan_sessions(spark, str(tmp_path))).collect()] == ["a", "b"]
    (tmp_path / "x.md").write_text("one\ntwo")
    read = files.read_documents(spark, f"file://{tmp_path}/x.md")
    assert read.first()["text"] == "one\ntwo"
    assert files.read_documents(spark, f"file://{tmp_path}/absent.md", optional=True).count() == 0
    assert [r["content"] for r in docs.read_lines(read, 1).collect()] == ["two"]
    (tmp_path / "goldens.json").write_text('[{"input": "a"}, {"input": "b"}]')
    assert files.read_goldens(spark, f"file://{tmp_path}/goldens.json").count() == 2
    files.append_history(spark.createDataFrame([("l1",)], "text string"), f"{tmp_path}/history")
    files.append_history(spark.createDataFrame([("l2",)], "text string"), f"{tmp_path}/history")
    assert spark.read.text(f"{tmp_path}/history").count() == 2


def test_messages_by_thread(spark, tmp_path):
    messages = spark.createDataFrame([(t, s, "human", f"{t}{s}") for t in range(20) for s in (2, 1)], "thread_id long, seq long, type string, content string")
    files.write_messages(messages, f"{tmp_path}/m", 8)
    got = files.read_thread(spark, f"{tmp_path}/m", 7, 8)
    assert [(r["seq"], r["content"]) for r in got.collect()] == [(1, "71"), (2, "72")]


def test_settings(spark):
    own = config.settings_from(spark, {"APP_A__B": "1", "app_map": '{"x":"y"}', "OTHER": "z"}, "APP_")
    assert {tuple(r) for r in own.collect()} == {("a.b", "1"), ("map", '{"x":"y"}')}
    assert config.map_setting(own, "map").first()["value"] == {"x": "y"}


def test_created_time_is_utc_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            said = spark.createDataFrame([(1700000000.9,), (1710053999.0,), (0.0,)], "s double").select(C.utc_text(F.col("s")).alias("t")).collect()
            assert [r["t"] for r in said] == ["2023-11-14 22:13:20", "2024-03-10 06:59:59", "1970-01-01 00:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_grep_looks_at_lines(spark):
    files_ = spark.createDataFrame([("a", "one\nfoo two\nbar foo"), ("b", "none")], "path string, text string")
    found = lambda pattern: [(r["path"], r["line"]) for r in docs.grep(files_, pattern).orderBy("path", "line").collect()]
    assert found(r"\Afoo") == [("a", 1)] and found("^foo") == [("a", 1)] and found(r"foo\z") == [("a", 2)] and found("(?i)FOO") == [("a", 1), ("a", 2)] and found("(?<!bar )foo") == [("a", 1)]


def test_errors_below_value_error(spark):
    rows = spark.createDataFrame([("t", "OwnError", ["OwnError", "ValueError"]), ("t", "OsError", ["OsError"]), ("t", "JSONDecodeError", None)], "tool string, error string, bases array<string>")
    assert [r["x"] is not None for r in rows.select(C.tool_error(F.col("tool"), F.col("error"), F.col("bases")).alias("x")).collect()] == [True, False, True]


def test_settings_tree(spark):
    tree = lambda env: config.settings_tree(config.settings_from(spark, env, "APP_"), "/here").first()
    usual = tree({})
    assert usual["backend"].asDict() == {"root_dir": "/here", "enable_shell": False} and usual["agent"]["model_kwargs"] == {}
    assert usual["model_call_limit"].asDict() == {"enable_call_limit": True, "thread_limit": None, "run_limit": 50, "exit_behavior": "end"}
    own = tree({"APP_AGENT__MODEL_KWARGS": '{"a": true}', "APP_BACKEND": '{"root_dir": "/x", "enable_shell": true}', "APP_BACKEND__ROOT_DIR": "/y"})
    assert own["agent"]["model_kwargs"] == {"a": "true"} and own["backend"].asDict() == {"root_dir": "/y", "enable_shell": True}
    for bad in ({"APP_TOOL_CALL_LIMIT__EXIT_BEHAVIOR": "stop"}, {"APP_MODEL_CALL_LIMIT__EXIT_BEHAVIOR": "continue"}, {"APP_RATE_LIMITER__MAX_BUCKET_SIZE": "many"}, {"APP_AGENT__MODEL_KWARGS": "{"}):
        with pytest.raises(Exception):
            tree(bad)


def test_documents_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([("s", 2, "Two", "a\nb\n"), ("s", 1, None, None), ("t", 1, "One", ""), (None, 1, "x", "y")], "slug string, chapter int, title string, text string")
    made = render.chapters(rows, "docs").unionByName(render.plan(rows.withColumnRenamed("title", "brief"), "docs"))
    render.write(made, str(tmp_path / "d"))
    got = {r["path"]: r["text"] for r in render.read(spark, str(tmp_path / "d")).collect()}
    assert got == {"docs/s/chapter-002.md": "# Two\n\na\nb\n\n", "docs/s/chapter-001.md": "# not decided\n\n\n", "docs/t/chapter-001.md": "# One\n\n\n", "docs/s-plan.md": "# s\n\n## Chapter 1\n\nnot decided\n\n## Chapter 2\n\nTwo\n", "docs/t-plan.md": "# t\n\n## Chapter 1\n\nOne\n"}


def test_style_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " .. \n\n !"), (4, "Go on. Stop!\n\nOne two three four")], "path int, text string")
    got = {r[0]: tuple(r)[1:] for r in docs.style_shape(rows).collect()}
    assert got[2] == (None, 0, None, None, None, 0, None) and got[1][0] is None
    assert got[4] == (25 / 7, 3, 4, (3 * 21 - 49) / 9, 2 / 32, 2, 4)
