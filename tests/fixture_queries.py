"""The operators over small inline tables with every awkward case, with SQL for each: what no driver table holds."""

from __future__ import annotations

from pyspark.sql import functions as F

import fixtures as X
from skein.functions import content as C
from skein.operators import catalog, config, coverage, docs, limits, render, stream
from skein.sources import files, sessions
from skein.sources.scratch import scratch_path
from skein.plans.registry import _CONTENT, _EDIT, _ENDS, _FIELDS, _SPACE
from skein.streaming import segments as live

QUERIES, SQL = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"SELECT path, text FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS k FROM {X.values(X.WRITES, 'path, seq, text')}) WHERE k = 1")
def latest_writes(spark, d):
    return docs.latest_writes(X.frame(spark, X.WRITES, "path string, seq int, text string"))


_EDIT = "CASE WHEN contains({text}, {e}.old) THEN replace({text}, {e}.old, {e}.new) ELSE {text} END"


@query(f"WITH e AS (SELECT * FROM {X.values(X.EDITS, 'path, seq, old, new', 'e')}), one AS (SELECT f.path, {_EDIT.format(text='f.text', e='e')} AS text, coalesce(contains(f.text, e.old), false) AS edited FROM {X.values(X.FILES, 'path, text', 'f')} LEFT JOIN e ON f.path = e.path AND e.seq = 1) SELECT one.path, {_EDIT.format(text='one.text', e='e')} AS text, edited OR coalesce(contains(one.text, e.old), false) AS edited FROM one LEFT JOIN e ON one.path = e.path AND e.seq = 2")
def edited_files(spark, d):
    return docs.edit(X.frame(spark, X.FILES, "path string, text string"), X.frame(spark, X.EDITS, "path string, seq int, old string, new string"))


@query(f"SELECT DISTINCT CASE WHEN contains(substr(path, 4), '/') THEN split_part(substr(path, 4), '/', 1) || '/' ELSE substr(path, 4) END AS name FROM {X.values(X.FILES, 'path, text')} WHERE path LIKE '/a/%'")
def list_files(spark, d):
    return docs.ls(X.frame(spark, X.FILES, "path string, text string"), "/a")


@query(f"SELECT path FROM {X.values(X.FILES, 'path, text')} WHERE regexp_full_match(path, '/a/(.*/)?[^/]*[.]md')")
def glob_files(spark, d):
    return docs.glob(X.frame(spark, X.FILES, "path string, text string"), "/a/**/*.md")


@query(_CONTENT.format(own="json_extract_string(b, '$')", values=X.values(X.CONTENT, "id, raw")))
def content_text(spark, d):
    return X.frame(spark, X.CONTENT, "id int, raw string").select("id", C.extract_text(F.parse_json("raw")).alias("text"))


@query(_CONTENT.format(own="''", values=X.values(X.CONTENT, "id, raw")))
def content_blocks(spark, d):
    return X.frame(spark, X.CONTENT, "id int, raw string").select("id", C.text_blocks(F.parse_json("raw")).alias("text"))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8195)"


@query(f"SELECT id, trim(text, {_SPACE}) AS text FROM {X.values(X.PADDED, 'id, text')}")
def strip_text(spark, d):
    return X.frame(spark, X.PADDED, "id int, text string").select("id", C.strip(F.col("text")).alias("text"))


@query(f"SELECT id, trim(regexp_replace(text, '\\A---\\n(?s:.*?)\\n---\\n', ''), {_SPACE}) AS body, regexp_extract(regexp_extract(text, '\\A---\\n((?s:.*?))\\n---\\n', 1), '(?m)^name: (.*)$', 1) AS name FROM {X.values(X.MARKDOWN, 'id, text')}")
def front_matter(spark, d):
    return X.frame(spark, X.MARKDOWN, "id int, text string").select("id", C.strip_front_matter(F.col("text")).alias("body"), C.front_matter_field(F.col("text"), "name").alias("name"))


@query(f"SELECT id, CASE WHEN t IN ('/exit', '/quit', '/help', '/session', '/reset') THEN t WHEN t <> '' THEN 'message' END AS command FROM (SELECT id, trim(text, {_SPACE}) AS t FROM {X.values(X.COMMAND_LINES, 'id, text')})")
def commands(spark, d):
    return X.frame(spark, X.COMMAND_LINES, "id int, text string").select("id", C.command(F.col("text")).alias("command"))


@query(f"SELECT id, CASE WHEN error IN ('ValueError', 'UnicodeError', 'UnicodeDecodeError', 'UnicodeEncodeError', 'UnicodeTranslateError', 'JSONDecodeError') THEN 'Tool `' || tool || '` failed: ' || error || '. Fix the input and retry.' END AS said FROM {X.values(X.ERRORS, 'id, tool, error')}")
def tool_errors(spark, d):
    return X.frame(spark, X.ERRORS, "id int, tool string, error string").select("id", C.tool_error(F.col("tool"), F.col("error")).alias("said"))


_CALL_ROWS = "session_id, run, seq, mode, node, pos, name, has_args, agent"


@query(f"SELECT session_id, run, seq, pos, CASE name WHEN 'task' THEN 'dispatching ' || coalesce(agent, '?') ELSE coalesce(name, 'tool') END AS label FROM {X.values(X.CALL_ROWS, _CALL_ROWS, 'c')} WHERE mode = 'updates' AND node = 'model' AND NOT EXISTS (SELECT 1 FROM {X.values(X.CALL_ROWS, _CALL_ROWS, 'b')} WHERE b.session_id = c.session_id AND b.run = c.run AND b.seq = c.seq AND b.pos <= c.pos AND b.name = 'task' AND NOT b.has_args)")
def tool_labels(spark, d):
    return stream.labels(X.frame(spark, X.TOOL_CALLS, live.EVENTS))


_ENDS = "CASE WHEN (mode = 'updates' AND node = 'model' AND n_calls > 0) OR mode IN ('end', 'interrupt') THEN 1 ELSE 0 END"


@query(f"SELECT session_id, run, segment, string_agg(text, '' ORDER BY seq, text) AS text FROM (SELECT *, CAST(sum({_ENDS}) OVER (PARTITION BY session_id, run ORDER BY seq) AS BIGINT) AS segment FROM {X.values(X.EVENT_ROWS, 'session_id, run, seq, mode, node, text, n_calls')}) WHERE mode = 'messages' AND node = 'model' AND text <> '' GROUP BY session_id, run, segment")
def stream_segments(spark, d):
    return stream.segments(X.frame(spark, X.TOOL_CALLS, live.EVENTS))


# --- sessions

@query(f"SELECT session_id, directory, strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created, CASE WHEN session_id LIKE '________-____-7%' THEN CAST('0x' || substr(replace(session_id, '-', ''), 1, 12) AS BIGINT) END AS id_millis FROM {X.values(X.SESSIONS, 'session_id, directory, is_dir, created_at')} WHERE is_dir ORDER BY session_id")
def session_list(spark, d):
    return sessions.list_sessions(X.frame(spark, X.SESSIONS, sessions.SCHEMA))


@query(f"SELECT session_id FROM {X.values([('my story',), ('absent',), (X.SESSIONS[3][0],)], 'session_id', 'a')} WHERE EXISTS (SELECT 1 FROM {X.values(X.SESSIONS, 'id, directory, is_dir, created_at', 's')} WHERE id = session_id AND is_dir)")
def resumable(spark, d):
    asked = X.frame(spark, [("my story",), ("absent",), (X.SESSIONS[3][0],)], "session_id string")
    return sessions.resumable(asked, X.frame(spark, X.SESSIONS, sessions.SCHEMA))


@query(f"SELECT session_id, '/data/sessions/' || session_id AS directory, '/data/sessions/' || session_id || '/checkpoints.sqlite' AS store FROM {X.values(X.SESSIONS, 'session_id, d, i, c')}")
def session_paths(spark, d):
    return sessions.paths(X.frame(spark, X.SESSIONS, sessions.SCHEMA), "/data/")


def _markdown_files(spark) -> str:
    """A folder with a file for each row of the fixture, below id=..."""
    path = scratch_path(spark, "markdown")
    X.frame(spark, X.MARKDOWN, "id int, text string").where("text is not null").repartition("id").write.partitionBy("id").text(path)
    return path


def _by_id(found):
    return found.select(F.regexp_extract("path", r"id=(\d+)/", 1).cast("int").alias("id"), "text")


@query(f"SELECT id, text || chr(10) AS text FROM {X.values(X.MARKDOWN, 'id, text')} WHERE text IS NOT NULL")
def whole_files(spark, d):
    return _by_id(files.read_documents(spark, f"{_markdown_files(spark)}/*/*.txt"))


@query(f"SELECT id, CASE WHEN id = 1 THEN coalesce(text || chr(10), '') ELSE '' END AS section FROM {X.values(X.MARKDOWN, 'id, text')}")
def optional_sections(spark, d):
    path = _markdown_files(spark)
    found = _by_id(files.read_documents(spark, f"{path}/id=1/*.txt", optional=True).unionAll(files.read_documents(spark, f"{path}/absent/*.txt", optional=True)))
    return X.frame(spark, X.MARKDOWN, "id int, own string").select("id").join(found, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("section"))


@query(f"SELECT id, scenario, outcome FROM {X.values(X.GOLDENS, 'id, scenario, outcome')}")
def goldens(spark, d):
    path = scratch_path(spark, "goldens")
    X.frame(spark, X.GOLDENS, "id int, scenario string, outcome string").agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
    return files.read_goldens(spark, path).select(F.col("id").cast("int").alias("id"), "scenario", "outcome")


# --- limits and configuration

@query(f"SELECT thread, run, seq, n, CASE WHEN lim IS NULL OR n <= lim THEN 'ok' ELSE 'error' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY thread, run ORDER BY seq) AS n FROM {X.values(X.CALLS, 'thread, run, seq, lim')})")
def call_limits(spark, d):
    return limits.call_status(X.frame(spark, X.CALLS, "thread string, run int, seq int, lim int"), ["thread", "run"], F.col("lim"), at_limit="error").drop("lim")


@query(f"SELECT thread, run, seq, n_run, n_thread, CASE WHEN coalesce(n_run <= run_limit, true) AND coalesce(n_thread <= thread_limit, true) THEN 'ok' ELSE 'end' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY thread, run ORDER BY seq) AS n_run, row_number() OVER (PARTITION BY thread ORDER BY run, seq) AS n_thread FROM {X.values(X.BOTH_LIMITS, 'thread, run, seq, run_limit, thread_limit')})")
def call_limits_together(spark, d):
    calls = X.frame(spark, X.BOTH_LIMITS, "thread string, run int, seq int, run_limit int, thread_limit int")
    return limits.call_status_within(calls, ["thread", "run"], F.col("run_limit"), ["thread"], F.col("thread_limit"), ["run", "seq"]).drop("run_limit", "thread_limit")


@query(f"SELECT id, attempt, first_delay * pow(factor, attempt) AS delay FROM (SELECT *, unnest(range(retries)) AS attempt FROM {X.values(X.RETRIES, 'id, retries, factor, first_delay')})")
def retry_delays(spark, d):
    return limits.retry_delays(X.frame(spark, X.RETRIES, "id int, retries int, factor double, first_delay double")).select("id", F.col("attempt").cast("long").alias("attempt"), "delay")


@query(f"SELECT id, attempt, delay, delay * 0.75::DOUBLE AS least, delay * 1.25::DOUBLE AS most FROM (SELECT id, attempt, first_delay * pow(factor, attempt) AS delay FROM (SELECT *, unnest(range(retries)) AS attempt FROM {X.values(X.RETRIES, 'id, retries, factor, first_delay')}))")
def retry_delay_bounds(spark, d):
    return limits.jittered(retry_delays(spark, d))


_SETTINGS = X.values(X.SETTINGS, "id, names, retry, model_limit, tool_limit")


@query(f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY part, ord) - 1 AS INTEGER) AS pos, stage FROM (SELECT id, 0 AS part, unnest(range(len(l))) AS ord, unnest(l) AS stage FROM (SELECT id, string_split(names, ',') AS l FROM {_SETTINGS}) UNION ALL SELECT id, 1, k, stage FROM (SELECT id, unnest([1, 2, 3, 4, 5]) AS k, unnest(['todo', 'retry', 'model_limit', 'tool_limit', 'tool_error']) AS stage, unnest([true, retry, model_limit, tool_limit, true]) AS built FROM {_SETTINGS}) WHERE built)")
def agent_stages(spark, d):
    rows = X.frame(spark, X.SETTINGS, "id int, names string, enable_retry boolean, enable_model_limit boolean, enable_tool_limit boolean")
    return config.stages(rows.withColumn("own", F.split("names", ",")))


@query(f"SELECT id, CASE WHEN shell THEN 'shell' ELSE 'files' END AS backend, 'read_file,write_file,edit_file,ls,glob,grep' || CASE WHEN shell THEN ',execute' ELSE '' END AS tools, CASE WHEN coalesce(limited, true) THEN rate END AS rate, CASE WHEN coalesce(limited, true) THEN burst END AS burst FROM {X.values(X.FLAGS, 'id, shell, limited, rate, burst')}")
def agent_equipment(spark, d):
    flags = X.frame(spark, X.FLAGS, "id int, enable_shell boolean, enable_rate_limiter boolean, requests_per_second int, max_bucket_size int")
    return config.equipment(flags).withColumn("tools", F.array_join("tools", ","))


def _setting(section: str, name: str, kind: str, default: str | None) -> str:
    usual = "'/here'" if name == "root_dir" else "NULL" if default is None else f"'{default}'"
    raw = f"coalesce(max(value) FILTER (WHERE path = '{section}.{name}'), json_extract_string(max(value) FILTER (WHERE path = '{section}'), '$.{name}'), {usual})"
    if kind == "boolean":
        raw = f"CASE lower({raw}) WHEN 'on' THEN 'true' WHEN 'off' THEN 'false' ELSE {raw} END"
    return f"CAST({raw} AS {kind}) AS {section}_{name}"


_FIELDS = [(section, *f) for section, fields in config.SECTIONS.items() for f in fields if not f[1].startswith("map")]


@query(f"SELECT {', '.join(_setting(*f) for f in _FIELDS)} FROM (SELECT replace(lower(name[5:]), '__', '.') AS path, value FROM {X.values(X.ENVIRONMENT, 'name, value')} WHERE starts_with(upper(name), 'APP_'))")
def settings_tree(spark, d):
    tree = config.settings_tree(config.settings_from(spark, dict(X.ENVIRONMENT), "APP_"), "/here")
    return tree.select(*(F.col(f"{section}.{name}").alias(f"{section}_{name}") for section, name, _, _ in _FIELDS))


@query(f"SELECT k AS name, json_extract_string(value, '$.' || k) AS text FROM (SELECT value, unnest(json_keys(value)) AS k FROM {X.values(X.MAP_SETTINGS, 'path, value')} WHERE path = 'agent.models')")
def map_settings(spark, d):
    found = config.map_setting(X.frame(spark, X.MAP_SETTINGS, "path string, value string"), "agent.models")
    return found.select(F.explode("value").alias("name", "text"))


@query(f"SELECT 0 AS part, ord, name, 'm' AS model FROM {X.values(X.FIXED_AGENTS, 'ord, name')} UNION ALL SELECT 1, ord, name, model FROM {X.values(X.OWN_AGENTS, 'ord, name, model')}")
def subagents(spark, d):
    fixed = X.frame(spark, X.FIXED_AGENTS, "ord int, name string")
    own = X.frame(spark, X.OWN_AGENTS, "ord int, name string, model string")
    return config.subagents(fixed, own, F.lit("m"))


@query(f"SELECT id, coalesce(nullif(cli, ''), nullif(env, ''), dflt) AS model, coalesce(nullif(sid, ''), new) AS session FROM {X.values(X.MODELS, 'id, cli, env, dflt, sid, new')}")
def effective_settings(spark, d):
    return config.effective(X.frame(spark, X.MODELS, "id int, cli string, env string, default_model string, session string, new_session string"))


@query(f"SELECT path, coalesce((SELECT max_by(backend, length(prefix)) FROM {X.values(X.ROUTES, 'prefix, backend', 'r')} WHERE starts_with(path, prefix)), 'default') AS backend FROM {X.values(X.PATHS, 'path')}")
def path_routes(spark, d):
    return config.routed(X.frame(spark, X.PATHS, "path string"), X.frame(spark, X.ROUTES, "prefix string, backend string"))


@query(f"SELECT coalesce(o.k, n.k) AS k, coalesce(o.v, n.v) AS v FROM {X.values(X.OLD_ROUTES, 'k, v', 'o')} FULL JOIN {X.values(X.NEW_ROUTES, 'k, v', 'n')} ON o.k = n.k")
def merged_routes(spark, d):
    maps = X.frame(spark, [(dict(X.OLD_ROUTES), dict(X.NEW_ROUTES))], "o map<string,string>, n map<string,string>")
    return maps.select(F.explode(C.merge_maps(F.col("o"), F.col("n"))).alias("k", "v"))


@query(f"SELECT id, concat_ws(chr(10) || chr(10), nullif(trim(application, {_SPACE}), ''), nullif(trim(regexp_replace(skill, '\\A---\\n(?s:.*?)\\n---\\n', ''), {_SPACE}), ''), nullif(trim(mapping, {_SPACE}), '')) AS prompt FROM {X.values(X.PROMPTS, 'id, application, skill, mapping')}")
def system_prompts(spark, d):
    return config.system_prompt(X.frame(spark, X.PROMPTS, "id int, application string, skill string, mapping string"))


# --- specification, plan and review

_SPEC = X.values(X.SPEC, "slug, dim, sub, choice", "s")
_FINDINGS = X.values(X.FINDINGS, "slug, dim, sub, status, note", "f")
_FAMILY = X.values([(f, dim) for f, dim, _ in catalog.DIMENSIONS], "family, dim", "d")
_COVERED = f"(SELECT s.slug, s.dim, s.sub, coalesce(f.status, 'Missing') AS status, f.note, family FROM {_SPEC} LEFT JOIN {_FINDINGS} ON f.slug = s.slug AND f.dim = s.dim AND f.sub = s.sub JOIN {_FAMILY} ON d.dim = s.dim)"
_CATALOGUE = X.values([(f, dim, k, s) for f, dim, subs in catalog.DIMENSIONS for k, s in enumerate(subs, 1)], "family, dim, ord, sub", "c")
_ASKS = "(family = 'core' OR (dim = 'scènes à faire' AND r NOT IN ('none', 'loosely inspired')) OR (r = 'parody' AND dim = 'parody/satire') OR (r = 'pastiche' AND dim = 'pastiche') OR (r = 'quotation' AND dim = 'quotation'))"
_REQUIRED = f"(SELECT slug, family, dim, ord, sub FROM (SELECT slug, coalesce(relationship, 'none') AS r FROM {X.values(X.STORIES, 'slug, relationship', 'st')}) JOIN {_CATALOGUE} ON {_ASKS})"


def _spec(spark):
    return X.frame(spark, X.SPEC, "slug string, dim string, sub string, choice string")


def _covered(spark):
    return coverage.coverage(_spec(spark), X.frame(spark, X.FINDINGS, "slug string, dim string, sub string, status string, note string"))


def _briefs(spark):
    rows = X.frame(spark, X.BRIEFS, "slug string, chapter int, pov string, pov_exception boolean, s string, p string")
    names = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return rows.select("slug", "chapter", "pov", "pov_exception", names("s").alias("setups"), names("p").alias("payoffs"))


_BRIEFS = X.values(X.BRIEFS, "slug, chapter, pov, pov_exception, s, p", "b")
_SETUPS = f"(SELECT slug, chapter, unnest(list_filter(string_split(s, ','), lambda x: x <> '')) AS element FROM {_BRIEFS})"
_PAYOFFS = f"(SELECT slug, chapter, unnest(list_filter(string_split(p, ','), lambda x: x <> '')) AS element FROM {_BRIEFS})"
_UNPAID = f"SELECT slug, chapter, element FROM {_SETUPS} a WHERE NOT EXISTS (SELECT 1 FROM {_PAYOFFS} z WHERE z.slug = a.slug AND z.element = a.element AND z.chapter > a.chapter)"
_DRIFT = f"SELECT slug, chapter, was, pov FROM (SELECT *, lag(pov) OVER (PARTITION BY slug ORDER BY chapter) AS was FROM {_BRIEFS}) WHERE was <> pov AND NOT coalesce(pov_exception, false)"


@query(f"SELECT * FROM {_REQUIRED}")
def required_answers(spark, d):
    return catalog.required_answers(X.frame(spark, X.STORIES, "slug string, relationship string"), catalog.dimensions(spark))


@query(f"SELECT slug, family, dim, ord, sub FROM {_REQUIRED} q WHERE NOT EXISTS (SELECT 1 FROM {_SPEC} WHERE s.slug = q.slug AND s.dim = q.dim AND s.sub = q.sub AND trim(choice) <> '')")
def unanswered_dimensions(spark, d):
    return coverage.unanswered(required_answers(spark, d), _spec(spark))


@query(f"SELECT slug, dim, sub, status, note FROM {_COVERED}")
def spec_coverage(spark, d):
    return _covered(spark)


@query(f"SELECT slug, dim, sub, status, CASE WHEN family <> 'core' THEN 3 WHEN status = 'Missing' THEN 1 ELSE 2 END AS rank FROM {_COVERED} WHERE status <> 'Covered'")
def findings_by_severity(spark, d):
    return coverage.severity(_covered(spark), catalog.dimensions(spark))


@query(f"SELECT slug, bool_or(family = 'core' AND status = 'Missing') AS blocked FROM {_COVERED} GROUP BY slug")
def chapter_gate(spark, d):
    return coverage.gate(_covered(spark), catalog.dimensions(spark))


@query(f"SELECT slug, dim, status, count(*) AS n FROM {_COVERED} GROUP BY ALL")
def findings_counts(spark, d):
    return coverage.status_counts(_covered(spark))


@query(f"SELECT DISTINCT slug, dim FROM {_SPEC} WHERE NOT EXISTS (SELECT 1 FROM {X.values(X.PLAN, 'slug, dim', 'p')} WHERE p.slug = s.slug AND p.dim = s.dim)")
def dimensions_without_plan(spark, d):
    return coverage.without_plan(_spec(spark), X.frame(spark, X.PLAN, "slug string, dim string"))


@query(f"SELECT 'docs/' || slug || '-spec.md' AS path, '# ' || slug || chr(10) || string_agg(part, '' ORDER BY dim) AS text FROM (SELECT slug, dim, chr(10) || '## ' || dim || chr(10) || chr(10) || string_agg('- **' || sub || '**: ' || coalesce(nullif(trim(replace(choice, chr(10), ' ')), ''), 'not decided') || chr(10), '' ORDER BY ord, sub) AS part FROM {X.values(X.SPEC_ROWS, 'slug, dim, ord, sub, choice')} GROUP BY slug, dim) GROUP BY slug")
def spec_documents(spark, d):
    return render.spec(X.frame(spark, X.SPEC_ROWS, "slug string, dim string, ord int, sub string, choice string"), "docs")


@query(f"SELECT slug, chapter FROM {X.values(X.CHAPTERS, 'slug, chapter', 'c')} WHERE NOT EXISTS (SELECT 1 FROM {_BRIEFS} WHERE b.slug = c.slug AND b.chapter = c.chapter)")
def chapters_without_brief(spark, d):
    return coverage.without_brief(X.frame(spark, X.CHAPTERS, "slug string, chapter int"), _briefs(spark))


@query(_UNPAID)
def unpaid_setups(spark, d):
    return coverage.unpaid_setups(_briefs(spark))


@query(_DRIFT)
def pov_drift(spark, d):
    return coverage.pov_drift(_briefs(spark))


@query(f"SELECT slug, (SELECT count(*) FROM ({_UNPAID}) u WHERE u.slug = t.slug) AS unpaid, (SELECT count(*) FROM ({_DRIFT}) v WHERE v.slug = t.slug) AS drifts FROM (SELECT DISTINCT slug FROM {_BRIEFS}) t")
def whole_story(spark, d):
    return coverage.whole_story(_briefs(spark))


@query(f"WITH a AS (SELECT slug, kind, min(made) AS made FROM {X.values(X.ARTEFACTS, 'slug, kind, made')} GROUP BY slug, kind) SELECT b.slug, b.kind, p.needs FROM a b JOIN (VALUES ('plan', 'spec'), ('prose', 'plan'), ('review', 'prose')) AS p(kind, needs) ON b.kind = p.kind LEFT JOIN a n ON n.slug = b.slug AND n.kind = p.needs WHERE n.made IS NULL OR b.made < n.made")
def workflow_order(spark, d):
    return coverage.out_of_order(X.frame(spark, X.ARTEFACTS, "slug string, kind string, at int"))


@query(f"SELECT slug FROM {X.values(X.GATES, 'slug, kind, signed')} WHERE signed AND kind IN ('spec', 'plan') GROUP BY slug HAVING count(DISTINCT kind) = 2")
def signed_off(spark, d):
    return coverage.signed_off(X.frame(spark, X.GATES, "slug string, kind string, signed boolean"))

