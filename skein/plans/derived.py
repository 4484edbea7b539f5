"""Tables of agents, sessions, stored documents and reviews, derived from the driver's tables by SQL that both Spark and
DuckDB run: so a query and its oracle read the same rows, and both grow with the tables.

`@name` in a derivation is another one, or a table. Texts are put together by ||, which a null makes null in both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from skein.operators.catalog import DIMENSIONS

_NUMBERED = [(f, dim, k, sub) for f, dim, subs in DIMENSIONS for k, sub in enumerate(subs, 1)]
#: The catalogue with running numbers, as a table of SQL.
CATALOGUE = "(SELECT * FROM (VALUES " + ", ".join(f"({n}, '{f}', '{dim}', {k}, '{sub}')" for n, (f, dim, k, sub) in enumerate(_NUMBERED)) + ") AS c(num, family, dim, ord, sub))"
_TEXT = "CAST({} AS STRING)"


def _text(x: str) -> str:
    return _TEXT.format(x)


def _uuid7(number: str) -> str:
    """A time-ordered identifier that a whole number makes, a second after that of the number before."""
    h = f"lower(lpad(hex(1700000000000 + {number} * 1000), 12, '0'))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-7abc-8abc-' || lower(lpad(hex({number}), 12, '0'))"


TABLES = {
    # stored documents
    "writes": f"SELECT '/users/' || {_text('user_id')} || '.md' AS path, event_id AS seq, props AS text FROM @events",
    "files": f"SELECT '/' || lang || '/' || source || '/' || {_text('doc_id')} || '.md' AS path, doc_id, text FROM @documents",
    "edits": "SELECT f.path AS path, 1 AS seq, 'a' AS old, 'the' AS new FROM @files f JOIN @labels l ON f.doc_id = l.doc_id WHERE l.quality = 1 UNION ALL SELECT f.path, 2, 'the', 'E e' FROM @files f JOIN @labels l ON f.doc_id = l.doc_id WHERE l.toxic = 0",
    # message content, lines of input, errors
    "contents": f"""SELECT event_id AS id, CASE event_type WHEN 'view' THEN '"' || event_type || '"' WHEN 'click' THEN '[{{"type":"text","text":"' || {_text('user_id')} || '"}},{{"type":"reasoning","summary":[]}},"' || event_type || '"]' WHEN 'error' THEN '[{{"type":"text"}},{{"type":"text","text":null}},{{"type":"text","text":"' || {_text('event_id')} || '"}}]' WHEN 'signup' THEN CASE WHEN value > 50 THEN '[]' WHEN value > 30 THEN '7' ELSE 'null' END ELSE props END AS raw FROM @events""",
    "padded": f"SELECT {_text('conv_id')} || '-' || {_text('turn')} AS id, CASE role WHEN 'user' THEN chr(9) || text || ' ' || chr(10) WHEN 'assistant' THEN chr(160) || text || chr(28) || chr(133) ELSE ' ' END AS text FROM @conversations",
    "markdown": "SELECT doc_id AS id, CASE lang WHEN 'en' THEN '---' || chr(10) || 'name: ' || source || chr(10) || 'description: d' || chr(10) || '---' || chr(10) || text WHEN 'de' THEN '---' || chr(10) || 'name: ' || source || chr(10) || '---' || text WHEN 'fr' THEN ' ---' || chr(10) || 'name: ' || source || chr(10) || '---' || chr(10) || text ELSE '---' || chr(10) || '---' || chr(10) || text || chr(10) || '---' || chr(10) || source END AS text FROM @documents",
    "command_lines": f"SELECT event_id AS id, CASE event_type WHEN 'view' THEN '/exit' WHEN 'click' THEN '  /help' || chr(9) WHEN 'error' THEN '/exit ' || {_text('user_id')} WHEN 'signup' THEN CASE WHEN value > 30 THEN '   ' ELSE '/QUIT' END ELSE '/session' || chr(10) END AS text FROM @events",
    "turns": "SELECT conv_id, turn, CASE role WHEN 'system' THEN ' /reset' || chr(10) ELSE text END AS text FROM @conversations UNION ALL SELECT conv_id, max(turn) + 1, chr(9) || ' ' FROM @conversations GROUP BY conv_id",
    "failures": "SELECT event_id AS id, event_type AS tool, CASE WHEN value < 10 THEN 'ValueError' WHEN value < 30 THEN 'KeyError' WHEN value < 60 THEN 'JSONDecodeError' WHEN value < 100 THEN NULL ELSE 'UnicodeDecodeError' END AS error FROM @events",
    # streamed turns: a run for each user; calls are up to two, of which the first may lack a name, arguments or an agent
    "steps": "SELECT 's' AS session_id, user_id AS run, event_id AS seq, CASE WHEN event_type IN ('purchase', 'error') THEN 'updates' WHEN event_type = 'signup' AND value > 60 THEN 'interrupt' ELSE 'messages' END AS mode, CASE WHEN event_type = 'signup' AND value > 60 THEN NULL WHEN event_type IN ('click', 'error') AND value > 80 THEN 'tools' ELSE 'model' END AS node, CASE WHEN event_type IN ('view', 'click') OR event_type = 'signup' AND value <= 60 THEN CASE WHEN value < 5 THEN '' ELSE event_type || ' ' END END AS text, CASE event_type WHEN 'purchase' THEN 2 WHEN 'error' THEN CASE WHEN value > 20 THEN 1 ELSE 0 END ELSE 0 END AS n_calls, CASE WHEN event_type = 'purchase' THEN 'task' WHEN value > 40 THEN 'grep' END AS name0, NOT (event_type = 'purchase' AND value > 70) AS args0, CASE WHEN event_type = 'purchase' AND value < 35 THEN 'writer' END AS agent0 FROM @events",
    "calls_made": "SELECT session_id, run, seq, mode, node, 0 AS pos, name0 AS name, args0 AS has_args, agent0 AS agent FROM @steps WHERE n_calls > 0 UNION ALL SELECT session_id, run, seq, mode, node, 1, 'ls', true, NULL FROM @steps WHERE n_calls > 1",
    # sessions
    "sessions": f"SELECT CASE WHEN c_acctbal < -900 THEN c_name ELSE {_uuid7('c_custkey')} END AS session_id, '/r/' || {_text('c_custkey')} AS directory, c_nationkey <> 7 AS is_dir, CAST(1700000000 + c_custkey * 61 AS DOUBLE) + 0.25 AS created_at FROM @customer",
    "asked": f"SELECT {_uuid7('s_suppkey * 3')} AS session_id FROM @supplier UNION ALL SELECT s_name FROM @supplier",
    # limits and settings
    "limited": "SELECT o_custkey AS thread, CAST(year(o_orderdate) AS INT) AS run, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN NULL ELSE 0 END AS lim FROM @orders",
    "limited_twice": "SELECT o_custkey AS thread, CAST(year(o_orderdate) AS INT) AS run, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN NULL ELSE 2 END AS run_limit, CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '5-LOW' THEN 4 ELSE 6 END AS thread_limit FROM @orders",
    "retried": "SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_linenumber - 2 AS INT) AS retries, CAST(CASE l_returnflag WHEN 'R' THEN 2.0 WHEN 'A' THEN 3.0 ELSE 1.5 END AS DOUBLE) AS factor, l_quantity AS first_delay FROM @lineitem",
    "settings": "SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'own' WHEN 'MACHINERY' THEN 'x,y' END AS names, c_acctbal > 0 AS enable_retry, c_nationkey > 10 AS enable_model_limit, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_acctbal > 3000 END AS enable_tool_limit FROM @customer",
    "flags": "SELECT c_custkey AS id, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_acctbal > 5000 END AS enable_shell, CASE WHEN c_nationkey > 20 THEN NULL ELSE c_acctbal > 1000 END AS enable_rate_limiter, c_nationkey AS requests_per_second, c_nationkey * 2 AS max_bucket_size FROM @customer",
    "variables": f"""SELECT c_custkey AS tenant, 'APP_RATE_LIMITER__MAX_BUCKET_SIZE' AS name, {_text('c_nationkey')} AS value FROM @customer WHERE c_nationkey > 3
        UNION ALL SELECT c_custkey, 'app_backend__enable_shell', CASE WHEN c_acctbal > 5000 THEN 'On' ELSE 'off' END FROM @customer WHERE c_acctbal > 0
        UNION ALL SELECT c_custkey, 'APP_MODEL_RETRY', '{{"max_retries": ' || {_text('c_nationkey')} || ', "jitter": false}}' FROM @customer WHERE c_mktsegment = 'BUILDING'
        UNION ALL SELECT c_custkey, 'APP_MODEL_RETRY__MAX_RETRIES', '9' FROM @customer WHERE c_nationkey = 7
        UNION ALL SELECT c_custkey, 'APP_TOOL_CALL_LIMIT__EXIT_BEHAVIOR', 'continue' FROM @customer WHERE c_mktsegment = 'FURNITURE'
        UNION ALL SELECT c_custkey, 'APP_UNKNOWN', c_name FROM @customer UNION ALL SELECT c_custkey, 'OTHER_PERSONAL__NAME', 'nobody' FROM @customer
        UNION ALL SELECT c_custkey, 'App_Personal__Name', c_name FROM @customer WHERE c_acctbal < 8000""",
    "map_settings": "SELECT event_id, event_type AS path, CASE WHEN value > 90 THEN 'no map' ELSE props END AS value FROM @events",
    "fixed_agents": "SELECT r_regionkey AS ord, r_name AS name FROM @region",
    "own_agents": "SELECT CAST(s_suppkey AS INT) AS ord, s_name AS name, CASE WHEN s_acctbal > 0 THEN 'm' || CAST(s_nationkey AS STRING) END AS model FROM @supplier",
    "models": f"SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'cli' WHEN 'MACHINERY' THEN '' END AS cli, CASE WHEN c_nationkey > 12 THEN 'env' || {_text('c_nationkey')} WHEN c_nationkey > 6 THEN '' END AS env, 'usual' AS default_model, CASE WHEN c_acctbal > 0 THEN c_name WHEN c_acctbal > -500 THEN '' END AS session, 'new' || {_text('c_custkey')} AS new_session FROM @customer",
    "routes": "SELECT DISTINCT '/' || lang || '/' AS prefix, lang AS backend FROM @documents WHERE lang <> 'de' UNION ALL SELECT DISTINCT '/' || lang || '/' || source, source FROM @documents WHERE lang <> 'en'",
    "old_routes": f"SELECT o_custkey AS id, o_orderpriority AS k, 'old ' || {_text('max(o_orderkey)')} AS v FROM @orders WHERE o_orderstatus = 'F' GROUP BY o_custkey, o_orderpriority",
    "new_routes": f"SELECT o_custkey AS id, o_orderpriority AS k, 'new ' || {_text('max(o_orderkey)')} AS v FROM @orders WHERE o_orderstatus = 'O' GROUP BY o_custkey, o_orderpriority",
    "prompts": "SELECT id, CASE WHEN source = 'src0' THEN ' ' ELSE chr(10) || source END AS application, m.text AS skill, CASE lang WHEN 'en' THEN chr(9) || 'map ' || source WHEN 'fr' THEN ' ' END AS mapping FROM @markdown m JOIN @documents d ON m.id = d.doc_id",
    # stories, their specifications, plans, briefs and reviews
    "stories": f"SELECT 's' || {_text('c_custkey')} AS slug, CASE c_mktsegment WHEN 'BUILDING' THEN 'retelling' WHEN 'MACHINERY' THEN 'parody' WHEN 'FURNITURE' THEN 'pastiche' WHEN 'HOUSEHOLD' THEN 'quotation' ELSE CASE WHEN c_acctbal > 5000 THEN 'loosely inspired' WHEN c_acctbal > 0 THEN 'none' END END AS relationship FROM @customer",
    "spec": f"SELECT 's' || {_text('o_custkey')} AS slug, dim, sub, ord, max(CASE o_orderstatus WHEN 'P' THEN ' ' WHEN 'F' THEN o_orderpriority || chr(10) || 'more' ELSE o_orderpriority END) AS choice FROM @orders JOIN {CATALOGUE} n ON num = o_orderkey % {len(_NUMBERED)} GROUP BY o_custkey, dim, sub, ord",
    "plan": f"SELECT DISTINCT 's' || {_text('o_custkey')} AS slug, dim FROM @orders JOIN {CATALOGUE} n ON num = o_orderkey % {len(_NUMBERED)} WHERE o_orderstatus = 'F'",
    "lines": f"SELECT 's' || {_text('o_custkey')} AS slug, l_linenumber AS chapter, dim, sub, CASE l_returnflag WHEN 'A' THEN 'Covered' WHEN 'R' THEN 'Partial' ELSE 'Missing' END AS status, l_quantity FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey JOIN {CATALOGUE} n ON num = o_orderkey % {len(_NUMBERED)}",
    "findings": f"SELECT slug, chapter, dim, sub, min(status) AS status, min('at ' || {_text('CAST(l_quantity AS INT)')}) AS note FROM @lines GROUP BY slug, chapter, dim, sub",
    "reviewed": "SELECT DISTINCT slug, chapter FROM @lines",
    "briefs": f"SELECT 'o' || {_text('l_orderkey')} AS slug, l_linenumber AS chapter, min(l_returnflag) AS pov, CASE WHEN min(l_linestatus) = 'O' THEN true WHEN min(l_discount) > 0.05 THEN false END AS pov_exception, CASE WHEN min(l_linestatus) = 'F' THEN 'e' || {_text('min(l_suppkey) % 3')} || ',x' ELSE '' END AS s, 'e' || {_text('min(l_partkey) % 3')} AS p FROM @lineitem GROUP BY l_orderkey, l_linenumber",
    "voices": f"SELECT 'o' || {_text('o_orderkey')} AS slug, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' END AS wanted FROM @orders",
    "planned": "SELECT slug, chapter FROM @briefs UNION ALL SELECT slug, max(chapter) + 1 FROM @briefs GROUP BY slug",
    "artefacts": f"SELECT 'u' || {_text('user_id')} AS slug, CASE event_type WHEN 'view' THEN 'spec' WHEN 'click' THEN 'plan' WHEN 'purchase' THEN 'prose' ELSE 'review' END AS kind, event_id AS made FROM @events WHERE event_type <> 'error' AND value > 20",
    "gates": f"SELECT 's' || {_text('o_custkey')} AS slug, CASE o_orderstatus WHEN 'F' THEN 'spec' WHEN 'O' THEN 'plan' ELSE 'prose' END AS kind, o_totalprice > 250000 AS signed FROM @orders",
    # files
    "notes": f"SELECT s_suppkey AS id, '# ' || s_name || chr(10) || 'nation ' || {_text('s_nationkey')} AS text FROM @supplier",
    "tests": "SELECT p_partkey AS id, p_brand AS brand, p_name || ' \"' || p_type || '\"' AS scenario, p_type AS outcome FROM @part",
}


def _expanded(name: str, table) -> str:
    return re.sub(r"@(\w+)", lambda m: f"({_expanded(m[1], table)})" if m[1] in TABLES else table(m[1]), TABLES[name])


def frame(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A derived table over the tables in a folder, as Spark computes it."""
    return spark.sql(_expanded(name, lambda t: f"parquet.`{d}/{t}.parquet`"))


def rows(name: str, alias: str = "t") -> str:
    """The same as a table of DuckDB's SQL."""
    return f"({_expanded(name, lambda t: t)}) AS {alias}"
