"""The library's queries by name, with their SQL where one can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import content as C
from skein.operators import catalog, config, coverage, docs, history, limits, render, stream
from skein.sources import files, sessions
from skein.sources.scratch import scratch_path
from skein.streaming import segments as token_stream

from . import derived as X

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import analytics, live  # noqa: F401  they add their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import analytics, live  # noqa: F401

    return dict(_SQL)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return history.messages_of(_table(spark, d, "conversations"))


# --- conversations as message histories

_KIND = "CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END"


@query("SELECT * FROM (SELECT conv_id AS thread_id, turn AS seq, CASE role WHEN 'user' THEN 'you>' WHEN 'assistant' THEN 'saga>' END AS label, text, count(*) OVER (PARTITION BY conv_id) AS n_messages FROM conversations) WHERE label IS NOT NULL AND trim(text) <> ''")
def replay_history(spark, d):
    return history.replay(_messages(spark, d))


@query("SELECT conv_id AS thread_id, count(*) AS n_messages, count(*) FILTER (WHERE role IN ('user', 'assistant') AND trim(text) <> '') AS n_shown FROM conversations GROUP BY conv_id")
def history_counts(spark, d):
    return history.history_counts(_messages(spark, d))


@query("SELECT conv_id AS thread_id, string_agg(text, '' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcript(spark, d):
    return history.transcript(_messages(spark, d))


@query(f"SELECT conv_id AS thread_id, max(turn) AS seq, max_by({_KIND}, turn) AS type, max_by(text, turn) AS text FROM conversations GROUP BY conv_id")
def latest_state(spark, d):
    return history.latest_state(_messages(spark, d))


@query("SELECT conv_id AS thread_id, turn AS seq FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.role = 'assistant' AND o.turn > c.turn)")
def unanswered(spark, d):
    return history.unanswered(_messages(spark, d))


@query("SELECT conv_id AS thread_id, min(turn) AS seq FROM conversations GROUP BY conv_id")
def first_of_thread(spark, d):
    return history.first_of_thread(_messages(spark, d))


@query("SELECT conv_id AS thread_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user' QUALIFY n <= 18")
def first_turns(spark, d):
    return history.first_turns(_messages(spark, d))


@query("SELECT conv_id, turn, n, CASE WHEN n <= 2 THEN 'ok' ELSE 'end' END AS status FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant')")
def call_cap(spark, d):
    calls = _table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn")
    return limits.call_status(calls, ["conv_id"], F.lit(2), "turn")


def _turn_events(spark, d):
    """Turns as events: what an assistant says is a token, a user's turn an end."""
    rows = _table(spark, d, "conversations").where("role in ('user', 'assistant')")
    said = F.col("role") == "assistant"
    return rows.select(F.lit("s").alias("session_id"), F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.when(said, "messages").otherwise("end").alias("mode"), F.when(said, "model").alias("node"), F.when(said, F.col("text")).alias("text"), F.lit(None).cast("array<struct<name:string,args:map<string,string>>>").alias("tool_calls"))


@query("SELECT 's' AS session_id, conv_id AS run, segment, string_agg(text, '' ORDER BY turn) AS text FROM (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS segment FROM conversations WHERE role IN ('user', 'assistant')) WHERE role = 'assistant' AND text <> '' GROUP BY conv_id, segment")
def reply_segments(spark, d):
    return stream.segments(_turn_events(spark, d))


@query("SELECT 's' AS session_id, conv_id AS run, segment, string_agg(text, '' ORDER BY turn) AS text FROM (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS segment FROM conversations WHERE role IN ('user', 'assistant')) WHERE role = 'assistant' AND text <> '' GROUP BY conv_id, segment")
def reply_segments_streamed(spark, d):
    events, out, checkpoint = (scratch_path(spark, x) for x in ("events", "segments", "checkpoint"))
    rows = _turn_events(spark, d)
    ends = rows.groupBy("session_id", "run").agg((F.max("seq") + 1).alias("seq")).select("session_id", "run", "seq", F.lit("end").alias("mode"))
    rows.unionByName(ends, allowMissingColumns=True).write.parquet(events)
    token_stream.run_segments(spark, events, out, checkpoint)
    return spark.read.schema("session_id string, run bigint, segment bigint, text string").parquet(out)


# --- stored documents

@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, lines[i] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(3, 1 + least(102, len(string_split(text, chr(10)))))) AS i FROM documents)")
def read_lines(spark, d):
    return docs.read_lines(_table(spark, d, "documents"), 2, path="doc_id")


@query("SELECT doc_id, line, content FROM (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, lines[i] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS i FROM documents)) WHERE regexp_matches(content, 'Copyright|[0-9]{4}')")
def grep_lines(spark, d):
    return docs.grep(_table(spark, d, "documents"), "Copyright|[0-9]{4}", "doc_id")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k FROM events")
def event_prop(spark, d):
    props = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    return _table(spark, d, "events").select("event_id", F.coalesce(props, F.lit("none")).alias("k"))


@query("SELECT user_id, date_trunc('second', ts) AS second, count(*) AS n, count(*) > 25 AS over FROM events GROUP BY ALL")
def calls_a_second(spark, d):
    out = limits.calls_a_second(_table(spark, d, "events"), ["user_id"])
    return out.withColumn("second", F.col("second").cast("timestamp_ntz"))


@query()
def token_bucket(spark, d):
    calls = _table(spark, d, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return limits.token_bucket(calls, "event_type", rate=0.01, burst=5)


@query(f"SELECT path, max_by(text, seq) AS text FROM {X.rows('writes')} GROUP BY path")
def latest_writes(spark, d):
    return docs.latest_writes(X.frame(spark, d, "writes"))


_EDIT = "CASE WHEN contains({text}, {e}.old) THEN replace({text}, {e}.old, {e}.new) ELSE {text} END"


@query(f"WITH e AS (SELECT * FROM {X.rows('edits')}), one AS (SELECT f.path, {_EDIT.format(text='f.text', e='e')} AS text, coalesce(contains(f.text, e.old), false) AS edited FROM {X.rows('files', 'f')} LEFT JOIN e ON f.path = e.path AND e.seq = 1) SELECT one.path, {_EDIT.format(text='one.text', e='e')} AS text, edited OR coalesce(contains(one.text, e.old), false) AS edited FROM one LEFT JOIN e ON one.path = e.path AND e.seq = 2")
def edited_files(spark, d):
    return docs.edit(X.frame(spark, d, "files"), X.frame(spark, d, "edits"))


@query(f"SELECT DISTINCT CASE WHEN contains(substr(path, 5), '/') THEN split_part(substr(path, 5), '/', 1) || '/' ELSE substr(path, 5) END AS name FROM {X.rows('files')} WHERE path LIKE '/en/%'")
def list_files(spark, d):
    return docs.ls(X.frame(spark, d, "files"), "/en")


@query(f"SELECT path FROM {X.rows('files')} WHERE regexp_full_match(path, '/en/(.*/)?[^/]*7[^/][.]md')")
def glob_files(spark, d):
    return docs.glob(X.frame(spark, d, "files"), "/en/**/*7?.md")


@query("SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(regexp_extract_all(text, '[.!?]')) AS BIGINT) AS n_sentences, CAST(len(regexp_extract_all(text, '[?]')) AS BIGINT) AS n_questions, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents)")
def style_measures(spark, d):
    return docs.style(_table(spark, d, "documents"), "doc_id")


def _lengths(end: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(text, '{end}'), lambda p: CAST(len(list_filter(regexp_split_to_array(p, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS BIGINT)), lambda n: n > 0)"


@query(f"SELECT doc_id, word_chars::DOUBLE / nullif(n, 0) AS mean_word_chars, CAST(len(s) AS BIGINT) AS n_sentences, list_max(s) AS longest_sentence, (len(s) * s2 - s1 * s1)::DOUBLE / nullif(len(s) * len(s), 0)::DOUBLE AS sentence_variance, marks::DOUBLE / nullif(chars, 0) AS mark_share, CAST(len(p) AS BIGINT) AS n_paragraphs, list_max(p) AS longest_paragraph FROM (SELECT doc_id, s, p, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, CAST(coalesce(list_sum(s), 0) AS BIGINT) AS s1, CAST(coalesce(list_sum(list_transform(s, lambda x: x * x)), 0) AS BIGINT) AS s2, len(regexp_extract_all(text, '[,;:.!?]')) AS marks, length(text) AS chars FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w, {_lengths('[.!?]')} AS s, {_lengths(chr(92) + 'n' + chr(92) + 'n+')} AS p FROM documents))")
def style_shape(spark, d):
    return docs.style_shape(_table(spark, d, "documents"), "doc_id")


# --- content, text and labels

_CONTENT = "SELECT id, CASE json_type(j) WHEN 'VARCHAR' THEN json_extract_string(j, '$') WHEN 'ARRAY' THEN coalesce((SELECT string_agg(CASE WHEN json_type(b) = 'VARCHAR' THEN {own} WHEN json_type(b) = 'OBJECT' AND json_extract_string(b, '$.type') = 'text' THEN coalesce(json_extract_string(b, '$.text'), '') ELSE '' END, '' ORDER BY i) FROM (SELECT unnest(TRY_CAST(j AS JSON[])) AS b, generate_subscripts(TRY_CAST(j AS JSON[]), 1) AS i)), '') ELSE '' END AS text FROM (SELECT id, CAST(raw AS JSON) AS j FROM {values})"


@query(_CONTENT.format(own="json_extract_string(b, '$')", values=X.rows("contents")))
def content_text(spark, d):
    return X.frame(spark, d, "contents").select("id", C.extract_text(F.parse_json("raw")).alias("text"))


@query(_CONTENT.format(own="''", values=X.rows("contents")))
def content_blocks(spark, d):
    return X.frame(spark, d, "contents").select("id", C.text_blocks(F.parse_json("raw")).alias("text"))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8195)"


@query(f"SELECT id, trim(text, {_SPACE}) AS text FROM {X.rows('padded')}")
def strip_text(spark, d):
    return X.frame(spark, d, "padded").select("id", C.strip(F.col("text")).alias("text"))


@query(f"SELECT id, trim(regexp_replace(text, '\\A---\\n(?s:.*?)\\n---\\n', ''), {_SPACE}) AS body, regexp_extract(regexp_extract(text, '\\A---\\n((?s:.*?))\\n---\\n', 1), '(?m)^name: (.*)$', 1) AS name FROM {X.rows('markdown')}")
def front_matter(spark, d):
    return X.frame(spark, d, "markdown").select("id", C.strip_front_matter(F.col("text")).alias("body"), C.front_matter_field(F.col("text"), "name").alias("name"))


@query(f"SELECT id, CASE WHEN t IN ('/exit', '/quit', '/help', '/session', '/reset') THEN t WHEN t <> '' THEN 'message' END AS command FROM (SELECT id, trim(text, {_SPACE}) AS t FROM {X.rows('command_lines')})")
def commands(spark, d):
    return X.frame(spark, d, "command_lines").select("id", C.command(F.col("text")).alias("command"))


@query(f"SELECT id, CASE WHEN error IN ('ValueError', 'UnicodeError', 'UnicodeDecodeError', 'UnicodeEncodeError', 'UnicodeTranslateError', 'JSONDecodeError') THEN 'Tool `' || tool || '` failed: ' || error || '. Fix the input and retry.' END AS said FROM {X.rows('failures')}")
def tool_errors(spark, d):
    return X.frame(spark, d, "failures").select("id", C.tool_error(F.col("tool"), F.col("error")).alias("said"))


def _steps(spark, d):
    """Events of streamed turns, with the calls of each step as a list."""
    first = "named_struct('name', name0, 'args', CASE WHEN args0 THEN CASE WHEN agent0 IS NULL THEN cast(map() AS map<string,string>) ELSE map('subagent_type', agent0) END END)"
    second = "named_struct('name', 'ls', 'args', cast(map() AS map<string,string>))"
    calls = F.expr(f"slice(array({first}, {second}), 1, n_calls)")
    return X.frame(spark, d, "steps").select("session_id", "run", "seq", "mode", "node", "text", calls.alias("tool_calls"))


@query(f"SELECT session_id, run, seq, pos, CASE name WHEN 'task' THEN 'dispatching ' || coalesce(agent, '?') ELSE coalesce(name, 'tool') END AS label FROM {X.rows('calls_made', 'c')} WHERE mode = 'updates' AND node = 'model' AND NOT EXISTS (SELECT 1 FROM {X.rows('calls_made', 'b')} WHERE b.session_id = c.session_id AND b.run = c.run AND b.seq = c.seq AND b.pos <= c.pos AND b.name = 'task' AND NOT b.has_args)")
def tool_labels(spark, d):
    return stream.labels(_steps(spark, d))


_ENDS = "CASE WHEN (mode = 'updates' AND node = 'model' AND n_calls > 0) OR mode IN ('end', 'interrupt') THEN 1 ELSE 0 END"


@query(f"SELECT session_id, run, segment, string_agg(text, '' ORDER BY seq, text) AS text FROM (SELECT *, CAST(sum({_ENDS}) OVER (PARTITION BY session_id, run ORDER BY seq) AS BIGINT) AS segment FROM {X.rows('steps')}) WHERE mode = 'messages' AND node = 'model' AND text <> '' GROUP BY session_id, run, segment")
def stream_segments(spark, d):
    return stream.segments(_steps(spark, d))


@query()
def new_session_ids(spark, d):
    """Random by nature: a UUID of version 7 for each user, with the time it holds."""
    return _table(spark, d, "customer").select("c_custkey", C.uuid7().alias("session_id")).withColumn("millis", C.uuid7_millis(F.col("session_id")))


# --- sessions

@query(f"SELECT session_id, directory, strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created, CASE WHEN session_id LIKE '________-____-7%' THEN CAST('0x' || substr(replace(session_id, '-', ''), 1, 12) AS BIGINT) END AS id_millis FROM {X.rows('sessions')} WHERE is_dir ORDER BY session_id")
def session_list(spark, d):
    return sessions.list_sessions(X.frame(spark, d, "sessions"))


@query(f"SELECT session_id FROM {X.rows('asked', 'a')} WHERE EXISTS (SELECT 1 FROM {X.rows('sessions', 's')} WHERE s.session_id = a.session_id AND is_dir)")
def resumable(spark, d):
    return sessions.resumable(X.frame(spark, d, "asked"), X.frame(spark, d, "sessions"))


@query(f"SELECT session_id, '/data/sessions/' || session_id AS directory, '/data/sessions/' || session_id || '/checkpoints.sqlite' AS store FROM {X.rows('sessions')}")
def session_paths(spark, d):
    return sessions.paths(X.frame(spark, d, "sessions"), "/data/")


# --- the same text functions over whole tables

def _turn_content(spark, d):
    """Turns with content as agents store it: what an assistant says is a text block beside a tool call, the rest a bare string in a list."""
    blocks = "to_json(array(named_struct('type', 'text', 'text', text), named_struct('type', 'tool_use', 'text', 'none')))"
    raw = F.expr(f"CASE WHEN role = 'assistant' THEN {blocks} ELSE to_json(array(text)) END")
    return _table(spark, d, "conversations").select("conv_id", "turn", F.parse_json(raw).alias("content"))


@query("SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations")
def turn_content(spark, d):
    return _turn_content(spark, d).select("conv_id", "turn", C.extract_text(F.col("content")).alias("text"))


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN coalesce(text, '') ELSE '' END AS text FROM conversations")
def turn_blocks(spark, d):
    return _turn_content(spark, d).select("conv_id", "turn", C.text_blocks(F.col("content")).alias("text"))


@query(f"SELECT conv_id, turn, t AS text, CASE WHEN t IN ('/exit', '/quit', '/help', '/session', '/reset') THEN t WHEN t <> '' THEN 'message' END AS command FROM (SELECT conv_id, turn, trim(text, {_SPACE}) AS t FROM {X.rows('turns')})")
def turn_commands(spark, d):
    """Turns as lines of input: a system turn stands for a reset, and a blank line ends each conversation."""
    return X.frame(spark, d, "turns").select("conv_id", "turn", C.strip(F.col("text")).alias("text"), C.command(F.col("text")).alias("command"))


@query(f"SELECT doc_id, trim(regexp_replace(t, '\\A---\\n(?s:.*?)\\n---\\n', ''), {_SPACE}) AS body, regexp_extract(regexp_extract(t, '\\A---\\n((?s:.*?))\\n---\\n', 1), '(?m)^name: (.*)$', 1) AS name FROM (SELECT doc_id, '---' || chr(10) || 'name: ' || source || chr(10) || '---' || chr(10) || text AS t FROM documents)")
def document_front_matter(spark, d):
    text = F.concat(F.lit("---\nname: "), "source", F.lit("\n---\n"), "text")
    return _table(spark, d, "documents").select("doc_id", C.strip_front_matter(text).alias("body"), C.front_matter_field(text, "name").alias("name"))


# --- stores, written and read back

@query(f"SELECT conv_id AS thread_id, turn AS seq, {_KIND} AS type, text FROM conversations")
def stored_messages(spark, d):
    path = scratch_path(spark, "messages")
    files.write_messages(_messages(spark, d), path)
    return spark.read.parquet(path).select("thread_id", "seq", "type", C.extract_text(F.col("content")).alias("text"))


@query(f"SELECT conv_id AS thread_id, turn AS seq, {_KIND} AS type, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def thread_state(spark, d):
    path = scratch_path(spark, "messages")
    messages = _messages(spark, d)
    files.write_messages(messages, path)
    asked = messages.agg(F.min("thread_id")).first()[0]
    return files.read_thread(spark, path, asked).select("thread_id", "seq", "type", C.extract_text(F.col("content")).alias("text"))


@query("WITH asked AS (SELECT s_suppkey AS thread_id FROM supplier), shown AS (SELECT conv_id AS thread_id, count(*) FILTER (WHERE role IN ('user', 'assistant') AND trim(text) <> '') AS n FROM conversations GROUP BY conv_id) SELECT thread_id, shown.n IS NOT NULL AS found, coalesce(shown.n, 0) AS n_shown FROM asked LEFT JOIN shown USING (thread_id)")
def absent_thread_replay(spark, d):
    """Threads asked for, those that no message has among them: an empty history shows nothing."""
    asked = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("thread_id"))
    return history.shown_of(asked, _messages(spark, d))


@query("SELECT regexp_replace(text, '[\\r\\n]', ' ', 'g') AS text FROM conversations WHERE role = 'user' AND text IS NOT NULL")
def input_history(spark, d):
    path = scratch_path(spark, "history")
    lines = _table(spark, d, "conversations").where("role = 'user' and text is not null").select("turn", F.regexp_replace("text", r"[\r\n]", " ").alias("text"))
    for early in (F.col("turn") < 2, F.col("turn") >= 2):  # two sessions add to one history
        files.append_history(lines.where(early), path)
    return spark.read.text(path).select(F.col("value").alias("text"))


def _note_files(spark, d) -> str:
    """A folder with a file for each note, part=.../id=....txt; a part is named by the first digit of its ids and a hash."""
    path, id_ = scratch_path(spark, "notes"), F.col("id").cast("string")
    part = F.concat_ws("-", F.substring(id_, 1, 1), F.pmod(F.xxhash64("id"), F.lit(64)))
    name = F.concat(F.lit("part="), part, F.lit("/id="), id_, F.lit(".txt"))
    files.write_documents(X.frame(spark, d, "notes").select(name.alias("path"), F.concat("text", F.lit("\n")).alias("text")), path)
    return path


def _by_id(found: DataFrame) -> DataFrame:
    return found.select(F.regexp_extract("path", r"id=(\d+)\.txt$", 1).cast("long").alias("id"), "text")


@query(f"SELECT id, text || chr(10) AS text FROM {X.rows('notes')}")
def whole_files(spark, d):
    return _by_id(files.read_documents(spark, _note_files(spark, d)))


@query(f"SELECT id, CASE WHEN CAST(id AS VARCHAR) LIKE '1%' THEN text || chr(10) ELSE '' END AS section FROM {X.rows('notes')}")
def optional_sections(spark, d):
    path = _note_files(spark, d)
    found = _by_id(files.read_documents(spark, f"{path}/part=1-*", optional=True).unionAll(files.read_documents(spark, f"{path}/part=absent-*", optional=True)))
    return X.frame(spark, d, "notes").select("id").join(found, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("section"))


@query(f"SELECT id, scenario, outcome FROM {X.rows('tests')}")
def goldens(spark, d):
    """A file of test cases for each brand, a list each."""
    path, rows = scratch_path(spark, "goldens"), X.frame(spark, d, "tests")
    lists = rows.groupBy("brand").agg(F.to_json(F.collect_list(F.struct("id", "scenario", "outcome"))).alias("value"))
    lists.repartition("brand").write.partitionBy("brand").text(path)
    return files.read_goldens(spark, path).select("id", "scenario", "outcome")


# --- limits and configuration

@query(f"SELECT thread, run, seq, n, CASE WHEN lim IS NULL OR n <= lim THEN 'ok' ELSE 'error' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY thread, run ORDER BY seq) AS n FROM {X.rows('limited')})")
def call_limits(spark, d):
    return limits.call_status(X.frame(spark, d, "limited"), ["thread", "run"], F.col("lim"), at_limit="error").drop("lim")


@query(f"SELECT thread, run, seq, n_run, n_thread, CASE WHEN coalesce(n_run <= run_limit, true) AND coalesce(n_thread <= thread_limit, true) THEN 'ok' ELSE 'end' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY thread, run ORDER BY run, seq) AS n_run, row_number() OVER (PARTITION BY thread ORDER BY run, seq) AS n_thread FROM {X.rows('limited_twice')})")
def call_limits_together(spark, d):
    found = limits.call_status_within(X.frame(spark, d, "limited_twice"), ["thread", "run"], F.col("run_limit"), ["thread"], F.col("thread_limit"), ["run", "seq"])
    return found.drop("run_limit", "thread_limit")


_DELAYS = f"SELECT id, line, attempt, first_delay * pow(factor, attempt) AS delay FROM (SELECT *, unnest(range(retries)) AS attempt FROM {X.rows('retried')})"


@query(_DELAYS)
def retry_delays(spark, d):
    return limits.retry_delays(X.frame(spark, d, "retried")).select("id", "line", F.col("attempt").cast("long").alias("attempt"), "delay")


@query(f"SELECT id, line, attempt, delay, delay * 0.75::DOUBLE AS least, delay * 1.25::DOUBLE AS most FROM ({_DELAYS})")
def retry_delay_bounds(spark, d):
    return limits.jittered(retry_delays(spark, d))


_SETTINGS = X.rows("settings")


@query(f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY part, ord) - 1 AS INTEGER) AS pos, stage FROM (SELECT id, 0 AS part, unnest(range(len(l))) AS ord, unnest(l) AS stage FROM (SELECT id, string_split(names, ',') AS l FROM {_SETTINGS}) UNION ALL SELECT id, 1, k, stage FROM (SELECT id, unnest([1, 2, 3, 4, 5]) AS k, unnest(['todo', 'retry', 'model_limit', 'tool_limit', 'tool_error']) AS stage, unnest([true, enable_retry, enable_model_limit, enable_tool_limit, true]) AS built FROM {_SETTINGS}) WHERE built)")
def agent_stages(spark, d):
    return config.stages(X.frame(spark, d, "settings").withColumn("own", F.split("names", ",")))


@query(f"SELECT id, CASE WHEN enable_shell THEN 'shell' ELSE 'files' END AS backend, 'read_file,write_file,edit_file,ls,glob,grep' || CASE WHEN enable_shell THEN ',execute' ELSE '' END AS tools, CASE WHEN coalesce(enable_rate_limiter, true) THEN requests_per_second END AS rate, CASE WHEN coalesce(enable_rate_limiter, true) THEN max_bucket_size END AS burst FROM {X.rows('flags')}")
def agent_equipment(spark, d):
    return config.equipment(X.frame(spark, d, "flags")).withColumn("tools", F.array_join("tools", ","))


def _setting(section: str, name: str, kind: str, default: str | None) -> str:
    usual = "'/here'" if name == "root_dir" else "NULL" if default is None else f"'{default}'"
    raw = f"coalesce(max(value) FILTER (WHERE path = '{section}.{name}'), json_extract_string(max(value) FILTER (WHERE path = '{section}'), '$.{name}'), {usual})"
    if kind == "boolean":
        raw = f"CASE lower({raw}) WHEN 'on' THEN 'true' WHEN 'off' THEN 'false' ELSE {raw} END"
    return f"CAST({raw} AS {kind}) AS {section}_{name}"


_FIELDS = [(section, *f) for section, fields in config.SECTIONS.items() for f in fields if not f[1].startswith("map")]


@query(f"SELECT tenant, {', '.join(_setting(*f) for f in _FIELDS)} FROM (SELECT tenant, replace(lower(name[5:]), '__', '.') AS path, value FROM {X.rows('variables')} WHERE starts_with(upper(name), 'APP_')) GROUP BY tenant")
def settings_tree(spark, d):
    tree = config.settings_tree(config.settings_of(X.frame(spark, d, "variables"), "APP_"), "/here", by=["tenant"])
    return tree.select("tenant", *(F.col(f"{section}.{name}").alias(f"{section}_{name}") for section, name, _, _ in _FIELDS))


@query(f"SELECT event_id, k AS name, json_extract_string(value, '$.' || k) AS text FROM (SELECT event_id, value, unnest(json_keys(value)) AS k FROM {X.rows('map_settings')} WHERE path = 'click' AND json_valid(value))")
def map_settings(spark, d):
    found = config.map_setting(X.frame(spark, d, "map_settings"), "click")
    return found.select("event_id", F.explode("value").alias("name", "text"))


@query(f"SELECT 0 AS part, ord, name, 'm' AS model FROM {X.rows('fixed_agents')} UNION ALL SELECT 1, ord, name, model FROM {X.rows('own_agents')}")
def subagents(spark, d):
    return config.subagents(X.frame(spark, d, "fixed_agents"), X.frame(spark, d, "own_agents"), F.lit("m"))


@query(f"SELECT id, coalesce(nullif(cli, ''), nullif(env, ''), default_model) AS model, coalesce(nullif(session, ''), new_session) AS session FROM {X.rows('models')}")
def effective_settings(spark, d):
    return config.effective(X.frame(spark, d, "models"))


@query(f"SELECT path, coalesce((SELECT max_by(backend, length(prefix)) FROM {X.rows('routes', 'r')} WHERE starts_with(path, prefix)), 'default') AS backend FROM {X.rows('files')}")
def path_routes(spark, d):
    return config.routed(X.frame(spark, d, "files").select("path"), X.frame(spark, d, "routes"))


@query(f"SELECT coalesce(o.id, n.id) AS id, coalesce(o.k, n.k) AS k, coalesce(o.v, n.v) AS v FROM {X.rows('old_routes', 'o')} FULL JOIN {X.rows('new_routes', 'n')} ON o.id = n.id AND o.k = n.k")
def merged_routes(spark, d):
    """A map of routes for each customer, bounded by the five priorities."""
    maps = [X.frame(spark, d, f"{x}_routes").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(x)) for x in ("old", "new")]
    none = F.expr("cast(map() AS map<string,string>)")
    return maps[0].join(maps[1], "id", "full").select("id", F.explode(C.merge_maps(F.coalesce("old", none), F.coalesce("new", none))).alias("k", "v"))


@query(f"SELECT id, concat_ws(chr(10) || chr(10), nullif(trim(application, {_SPACE}), ''), nullif(trim(regexp_replace(skill, '\\A---\\n(?s:.*?)\\n---\\n', ''), {_SPACE}), ''), nullif(trim(mapping, {_SPACE}), '')) AS prompt FROM {X.rows('prompts')}")
def system_prompts(spark, d):
    return config.system_prompt(X.frame(spark, d, "prompts"))


# --- specification, plan and review

_SPEC, _PLAN, _FINDINGS, _BRIEFS = (X.rows(n, n[0]) for n in ("spec", "plan", "findings", "briefs"))
_CATALOGUE = f"{X.CATALOGUE} c"
_FAMILY = f"(SELECT DISTINCT family, dim FROM {_CATALOGUE}) d"
_COVERED = f"(SELECT s.slug, r.chapter, s.dim, s.sub, coalesce(f.status, 'Missing') AS status, f.note, family FROM {_SPEC} JOIN {X.rows('reviewed', 'r')} ON r.slug = s.slug LEFT JOIN {_FINDINGS} ON f.slug = s.slug AND f.chapter = r.chapter AND f.dim = s.dim AND f.sub = s.sub JOIN {_FAMILY} ON d.dim = s.dim)"
_ASKS = "(family = 'core' OR (dim = 'scènes à faire' AND r NOT IN ('none', 'loosely inspired')) OR (r = 'parody' AND dim = 'parody/satire') OR (r = 'pastiche' AND dim = 'pastiche') OR (r = 'quotation' AND dim = 'quotation'))"
_REQUIRED = f"(SELECT slug, family, dim, ord, sub FROM (SELECT slug, coalesce(relationship, 'none') AS r FROM {X.rows('stories')}) JOIN {_CATALOGUE} ON {_ASKS})"


def _covered(spark, d):
    return coverage.coverage(X.frame(spark, d, "spec"), X.frame(spark, d, "findings"), X.frame(spark, d, "reviewed"))


def _briefs(spark, d):
    names = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return X.frame(spark, d, "briefs").select("slug", "chapter", "pov", "pov_exception", names("s").alias("setups"), names("p").alias("payoffs"))


_SETUPS = f"(SELECT slug, chapter, unnest(list_filter(string_split(s, ','), lambda x: x <> '')) AS element FROM {_BRIEFS})"
_PAYOFFS = f"(SELECT slug, chapter, unnest(list_filter(string_split(p, ','), lambda x: x <> '')) AS element FROM {_BRIEFS})"
_UNPAID = f"SELECT slug, chapter, element FROM {_SETUPS} a WHERE NOT EXISTS (SELECT 1 FROM {_PAYOFFS} z WHERE z.slug = a.slug AND z.element = a.element AND z.chapter > a.chapter)"
_DRIFT = f"SELECT slug, chapter, was, wanted, pov FROM (SELECT *, lag(pov) OVER (PARTITION BY slug ORDER BY chapter) AS was FROM {_BRIEFS}) LEFT JOIN {X.rows('voices', 'v')} USING (slug) WHERE (coalesce(was <> pov, false) OR coalesce(wanted <> pov, false)) AND NOT coalesce(pov_exception, false)"


@query(f"SELECT family, dim, CAST(ord AS INTEGER) AS ord, sub, count(slug) AS n_stories FROM {_CATALOGUE} LEFT JOIN {_REQUIRED} q USING (family, dim, ord, sub) GROUP BY ALL")
def dimension_catalogue(spark, d):
    """The catalogue, and how many stories each of its rows is asked of."""
    asked = required_answers(spark, d).groupBy("dim", "sub").agg(F.count("*").alias("n"))
    rows = catalog.dimensions(spark).join(asked, ["dim", "sub"], "left")
    return rows.select("family", "dim", "ord", "sub", F.coalesce("n", F.lit(0)).cast("long").alias("n_stories"))


@query(f"SELECT slug, family, dim, CAST(ord AS INTEGER) AS ord, sub FROM {_REQUIRED}")
def required_answers(spark, d):
    return catalog.required_answers(X.frame(spark, d, "stories"), catalog.dimensions(spark))


@query(f"SELECT slug, family, dim, CAST(ord AS INTEGER) AS ord, sub FROM {_REQUIRED} q WHERE NOT EXISTS (SELECT 1 FROM {_SPEC} WHERE s.slug = q.slug AND s.dim = q.dim AND s.sub = q.sub AND trim(choice) <> '')")
def unanswered_dimensions(spark, d):
    return coverage.unanswered(required_answers(spark, d), X.frame(spark, d, "spec"))


@query(f"SELECT slug, chapter, dim, sub, status, note FROM {_COVERED}")
def spec_coverage(spark, d):
    return _covered(spark, d)


@query(f"SELECT slug, chapter, dim, sub, status, CASE WHEN family <> 'core' THEN 3 WHEN status = 'Missing' THEN 1 ELSE 2 END AS rank FROM {_COVERED} WHERE status <> 'Covered'")
def findings_by_severity(spark, d):
    return coverage.severity(_covered(spark, d), catalog.dimensions(spark))


@query(f"WITH g AS (SELECT slug, chapter, bool_or(family = 'core' AND status = 'Missing') AS blocked FROM {_COVERED} GROUP BY slug, chapter) SELECT slug, chapter, blocked, NOT EXISTS (SELECT 1 FROM g b WHERE b.slug = g.slug AND b.chapter < g.chapter AND b.blocked) AS may_start FROM g")
def chapter_gate(spark, d):
    return coverage.gate(_covered(spark, d), catalog.dimensions(spark))


@query(f"SELECT slug, chapter, dim, status, count(*) AS n FROM {_COVERED} GROUP BY ALL")
def findings_counts(spark, d):
    return coverage.status_counts(_covered(spark, d))


@query(f"SELECT DISTINCT slug, dim FROM {_SPEC} WHERE NOT EXISTS (SELECT 1 FROM {_PLAN} WHERE p.slug = s.slug AND p.dim = s.dim)")
def dimensions_without_plan(spark, d):
    return coverage.without_plan(X.frame(spark, d, "spec"), X.frame(spark, d, "plan"))


@query(f"SELECT 'docs/' || slug || '-spec.md' AS path, '# ' || slug || chr(10) || string_agg(part, '' ORDER BY dim) AS text FROM (SELECT slug, dim, chr(10) || '## ' || dim || chr(10) || chr(10) || string_agg('- **' || sub || '**: ' || coalesce(nullif(trim(replace(choice, chr(10), ' ')), ''), 'not decided') || chr(10), '' ORDER BY ord, sub) AS part FROM {_SPEC} GROUP BY slug, dim) GROUP BY slug")
def spec_documents(spark, d):
    return render.spec(X.frame(spark, d, "spec"), "docs")


@query(f"SELECT 'docs/' || slug || '-plan.md' AS path, '# ' || slug || chr(10) || string_agg(chr(10) || '## Chapter ' || CAST(chapter AS VARCHAR) || chr(10) || chr(10) || 'told by ' || pov || chr(10), '' ORDER BY chapter) AS text FROM {_BRIEFS} GROUP BY slug")
def plan_documents(spark, d):
    return render.plan(X.frame(spark, d, "briefs").select("slug", "chapter", F.concat(F.lit("told by "), "pov").alias("brief")), "docs")


@query(f"SELECT 'docs/' || slug || '/chapter-' || lpad(CAST(chapter AS VARCHAR), 3, '0') || '.md' AS path, '# told by ' || pov || chr(10) || chr(10) || p || chr(10) AS text FROM {_BRIEFS}")
def chapter_documents(spark, d):
    return render.chapters(X.frame(spark, d, "briefs").select("slug", "chapter", F.concat(F.lit("told by "), "pov").alias("title"), F.col("p").alias("text")), "docs")


@query(f"SELECT slug, chapter FROM {X.rows('planned', 'c')} WHERE NOT EXISTS (SELECT 1 FROM {_BRIEFS} WHERE b.slug = c.slug AND b.chapter = c.chapter)")
def chapters_without_brief(spark, d):
    return coverage.without_brief(X.frame(spark, d, "planned"), _briefs(spark, d))


@query(_UNPAID)
def unpaid_setups(spark, d):
    return coverage.unpaid_setups(_briefs(spark, d))


@query(_DRIFT)
def pov_drift(spark, d):
    return coverage.pov_drift(_briefs(spark, d), X.frame(spark, d, "voices"))


@query(f"SELECT slug, coalesce(u.n, 0) AS unpaid, coalesce(v.n, 0) AS drifts FROM (SELECT DISTINCT slug FROM {_BRIEFS}) t LEFT JOIN (SELECT slug, count(*) AS n FROM ({_UNPAID}) GROUP BY slug) u USING (slug) LEFT JOIN (SELECT slug, count(*) AS n FROM ({_DRIFT}) GROUP BY slug) v USING (slug)")
def whole_story(spark, d):
    return coverage.whole_story(_briefs(spark, d), X.frame(spark, d, "voices"))


@query("SELECT conv_id AS slug, turn AS chapter, coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS so_far FROM conversations")
def continuity(spark, d):
    rows = _table(spark, d, "conversations").select(F.col("conv_id").alias("slug"), F.col("turn").alias("chapter"), F.col("text").alias("summary"))
    return coverage.continuity(rows)


@query(f"WITH a AS (SELECT slug, kind, min(made) AS made FROM {X.rows('artefacts')} GROUP BY slug, kind) SELECT b.slug, b.kind, p.needs FROM a b JOIN (VALUES ('plan', 'spec'), ('prose', 'plan'), ('review', 'prose')) AS p(kind, needs) ON b.kind = p.kind LEFT JOIN a n ON n.slug = b.slug AND n.kind = p.needs WHERE n.made IS NULL OR b.made < n.made")
def workflow_order(spark, d):
    return coverage.out_of_order(X.frame(spark, d, "artefacts").withColumnRenamed("made", "at"))


@query(f"SELECT slug FROM {X.rows('gates')} WHERE signed AND kind IN ('spec', 'plan') GROUP BY slug HAVING count(DISTINCT kind) = 2")
def signed_off(spark, d):
    return coverage.signed_off(X.frame(spark, d, "gates"))
