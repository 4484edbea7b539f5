"""SQL for DuckDB that gives the rows of those queries which SQL can express."""

from __future__ import annotations

from . import quality_rules as Q
from . import url_filter as U

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(string_split_regex({}, '{}'), lambda x: x <> '')"
_WHITE = r"[\x20\x09-\x0D]+"


def _quality_rules() -> str:
    kinds = ("[a-z]", _WHITE, "[A-Z]", "[0-9]", "[#*$%&|<>]", r"[\x00-\x7F]")
    count = lambda kind: f"length(regexp_replace(t, '{kind}', '', 'g'))"
    named = [f"length(t) - {count(k)}" for k in kinds]
    classes = ", ".join([*named[:5], f"{named[5]} - ({' + '.join('(' + x + ')' for x in named[:5])})", count(kinds[5])])
    words = "[" + ", ".join(f"'{w}'" for w in Q.WORDS) + "]"
    langs = "(" + ", ".join(f"'{x}'" for x in Q.COMMON_WORDS) + ")"
    half = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / (p + r)) ELSE 0 END"
    distance = lambda kind: f"SELECT doc_id, min(d) AS d FROM (SELECT s.doc_id, s.lang, r.lang AS other, sqrt(greatest(0, sum({half('p')} + {half('r')}) / 2)) AS d FROM shares s JOIN refs r USING (kind, k) WHERE kind = '{kind}' GROUP BY ALL) GROUP BY doc_id"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_SPLIT.format('t', _WHITE)} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
runs AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS c FROM runs) WHERE c > 1) GROUP BY doc_id),
base AS (SELECT w.*, len(ws) AS n_words, length(t) - (length(t) - {count(_WHITE)}) AS word_chars, length(t) - {count(kinds[4])} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, [{classes}] AS classes, list_transform({words}, lambda k: len(list_filter(ws, lambda x: x = k))) AS common FROM w LEFT JOIN again USING (doc_id)),
full_ AS (SELECT *, list_append(common, n_words - list_sum(common)) AS said FROM base),
shares AS (SELECT doc_id, lang, n_words, length(t) AS n_points, 'c' AS kind, unnest(range(1, len(classes) + 1)) AS k, unnest(list_transform(classes, lambda x: x / greatest(1, list_sum(classes)))) AS p FROM full_
  UNION ALL SELECT doc_id, lang, n_words, length(t), 'w', unnest(range(1, len(said) + 1)), unnest(list_transform(said, lambda x: x / greatest(1, list_sum(said)))) FROM full_),
refs AS (SELECT lang, kind, k, avg(p) AS r FROM shares WHERE lang IN {langs} AND n_words >= {Q.LEAST_WORDS} AND n_points >= {Q.LEAST_CHARS} GROUP BY ALL),
judged AS (SELECT f.*, n_words < {Q.BASE_WORDS} OR 100 * n_repeat_words > {Q.BASE_REPEATS} * n_words AS base_failed, lang IS NULL OR lang IN (SELECT lang FROM refs) AS known FROM full_ f)
SELECT j.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND (NOT known OR length(t) < {Q.LEAST_CHARS} OR coalesce(c.d, 0) <= {Q.MOST_CLASSES}) AND (NOT known OR n_words < {Q.LEAST_WORDS} OR coalesce(x.d, 0) <= {Q.MOST_WORDS}) AS kept
FROM judged j LEFT JOIN ({distance('c')}) c USING (doc_id) LEFT JOIN ({distance('w')}) x USING (doc_id)"""


_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h) AS n, sha1(h) AS digest FROM p),
m AS (SELECT digest, max(page_id) AS largest FROM k WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, k.digest AS payload_digest, CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < largest THEN largest END AS refers_to
FROM k LEFT JOIN m ON n >= 1000 AND k.digest = m.digest"""

_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(_LOW, _WHITE)} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(ws) - 4) + 1), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS x FROM s),
l AS (SELECT a.doc_id AS p, b.doc_id AS q FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS p, doc_id AS q FROM s UNION SELECT r.p, l.q FROM r JOIN l ON r.q = l.p)
SELECT s.doc_id, CAST(any_value(len(shingles)) AS BIGINT) AS n_shingles, min(r.q) AS component_id FROM s JOIN r ON r.p = s.doc_id GROUP BY s.doc_id"""


def _url_filter() -> str:
    rule = lambda host, path: f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
    by_length = sorted(U.RULES, key=lambda r: -len(r[1] + r[2]))
    pick = lambda get: "CASE " + " ".join(f"WHEN {rule(h, p)} THEN '{get(v, h, p)}'" for v, h, p in by_length) + " {} END"
    glob = lambda g: "".join({"**": ".*", "*": "[^/]*"}.get(x, "".join("[.]" if c == "." else c for c in x)) for x in U.parts(g))
    bad = " OR ".join(f"regexp_full_match(whole, '(?s){glob(g)}')" for g in U.BLOCKED_GLOBS)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN split_part(split_part(substr(url, instr(url, '://') + 3), '#', 1), '?', 1) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(split_part(coalesce(rest, ''), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, CASE WHEN contains(rest, '/') THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM a),
c AS (SELECT *, CASE WHEN host = '' AND path = '' THEN '' ELSE '.' || host || path END AS whole FROM b)
SELECT page_id, host, path, {pick(lambda v, h, p: h + p).format('')} AS rule, {pick(lambda v, h, p: v).format(f"WHEN {bad} THEN 'block' ELSE 'allow'")} AS verdict FROM c"""


_BENCHMARK_WORDS = _SPLIT.format(_LOW, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_DECONTAMINATE = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCHMARK_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[k : k + 9], ' ') AS said FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_BENCHMARK_WORDS} AS ws FROM documents),
o AS (SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS said FROM (SELECT d.*, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v))),
f AS (SELECT doc_id, k, o.n, item FROM o JOIN v ON o.n = v.n AND o.said = v.said),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM f) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(g.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)"""


def _filter_audit() -> str:
    letters = "(SELECT unnest(range(5)) AS j)"
    pick = ", ".join(f"p{k}.j AS j{k}" for k in range(1, 6))
    joins = " ".join(f"JOIN {letters} p{k} ON p{k}.j NOT IN ({', '.join(f'p{i}.j' for i in range(1, k))})" for k in range(2, 6))
    subset = lambda k: " + ".join(["0", *(f"(1 << j{i})" for i in range(1, k))])
    named = " || ".join(f"chr(CAST(65 + j{k} AS INTEGER))" for k in range(1, 6))
    each = " UNION ALL ".join(f"SELECT {named} AS filter_order, {k} AS step, {subset(k)} AS before, j{k} AS j FROM orders" for k in range(1, 6))
    lost = lambda c: f"CAST(b.{c} - a.{c} AS BIGINT)"
    return f"""
WITH marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_SPLIT.format("coalesce(text, '')", _WHITE)} AS ws FROM documents),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d LEFT JOIN marks USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, mask),
s AS (SELECT part, s, coalesce(sum(n) FILTER (WHERE mask & s = 0), 0) AS n, coalesce(sum(good) FILTER (WHERE mask & s = 0), 0) AS good, coalesce(sum(toxic) FILTER (WHERE mask & s = 0), 0) AS toxic, coalesce(sum(n) FILTER (WHERE mask = s), 0) AS own FROM c, (SELECT unnest(range(32)) AS s) GROUP BY part, s),
orders AS (SELECT {pick} FROM {letters} p1 {joins}),
steps AS ({each}),
r AS (SELECT b.part, filter_order, step, j, a.n AS kept, {lost('n')} AS removed, CAST(z.n - y.n AS BIGINT) - {lost('n')} AS redundant, y.own AS unique_fails, {lost('good')} AS good_lost, {lost('toxic')} AS toxic_lost
  FROM steps JOIN s b ON b.s = before JOIN s a ON a.part = b.part AND a.s = before + (1 << j) JOIN s z ON z.part = b.part AND z.s = 0 JOIN s y ON y.part = b.part AND y.s = (1 << j))
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, removed, redundant, CAST(unique_fails AS BIGINT) AS unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, j) AS BIGINT) AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _quality_rules(), "op5_warc": _WARC, "op6_jaccard_join": _JACCARD, "op7_url_filter": _url_filter(), "op9_decontaminate": _DECONTAMINATE, "op11_filter_audit": _filter_audit()}
