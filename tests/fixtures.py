"""Small inline tables for what the driver's tables do not hold; as frames, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.operators.catalog import DIMENSIONS, RELATIONSHIPS

CONTENT = [
    (1, '"plain"'), (2, '[{"type":"text","text":"a"},{"type":"reasoning","summary":[]},"b"]'), (3, '[{"type":"text"},{"type":"text","text":null},{"type":"text","text":"c"}]'),
    (4, "null"), (5, "7"), (6, '{"type":"text","text":"x"}'), (7, "[]"), (8, '["only","strings"]'),
]
COMMAND_LINES = [(1, "/exit"), (2, "  /help\t"), (3, "/EXIT"), (4, "/exit now"), (5, "   "), (6, "hello"), (7, "/reset"), (8, "/session"), (9, "/quit\n")]
MARKDOWN = [(1, "---\nname: a b\ndescription: d\n---\n\n# Body\n"), (2, "no fence"), (3, "---\nname: x\n---no line end"), (4, "---\n---\ntext\n---\nrest"), (5, " ---\nname: y\n---\nz"), (6, "---\nname: q\n---\nkeep\n---\nthis\n---\n")]
PADDED = [(1, "\t a b \n"), (2, " x "), (3, "\u0085\x1cy\x1f"), (4, "plain"), (5, "  "), (6, "")]
ERRORS = [(1, "read_file", "ValueError"), (2, "grep", "KeyError"), (3, "ls", None), (4, "edit_file", "UnicodeDecodeError"), (5, "task", "JSONDecodeError")]
SESSIONS = [
    ("01890a5d-ac96-774b-bcce-b302099a8057", "/r/1", True, 1700000300.0), ("01890a5d-ac95-774b-bcce-b302099a8057", "/r/2", True, 1700000400.5),
    ("my story", "/r/3", True, 1700000000.0), ("01890a5d-ac97-774b-bcce-b302099a8057", "/r/4", False, 1700000000.0),
]
CALLS = [("a", 1, s, lim) for lim in (2,) for s in range(1, 5)] + [("b", 1, s, None) for s in range(1, 4)] + [("c", 1, 1, 0)]
RETRIES = [(1, 3, 2.0, 1.0), (2, 0, 2.0, 1.0), (3, 2, 3.0, 0.5)]
STORIES = [(f"s{i}", r) for i, r in enumerate(RELATIONSHIPS)] + [("s9", None)]
SPEC = [("s0", d, s, "chosen" if k % 7 else " ") for k, (f, d, subs) in enumerate((x for x in DIMENSIONS if x[0] == "core"), 1) for s in subs] + [("s3", "parody/satire", "evocation", "does not apply"), ("s3", "character", "identity & traits", "bold")]
FINDINGS = [("s0", "writing style", "tone & voice", "Covered", "ok"), ("s0", "writing style", "rhythm & flow", "Partial", "some"), ("s3", "parody/satire", "evocation", "Partial", "weak"), ("s3", "character", "identity & traits", "Covered", "yes")]
PLAN = [("s0", "writing style"), ("s0", "character"), ("s3", "parody/satire")]
CHAPTERS = [("s0", c) for c in (1, 2, 3, 4, 5)]
BRIEFS = [("s0", 1, "Ann", False, "ring,map", ""), ("s0", 2, "Bob", False, "key", "ring"), ("s0", 3, "Ann", True, "door", "door"), ("s0", 4, "Ann", None, "", "lost"), ("s1", 1, None, False, "sword", ""), ("s1", 2, "Cy", False, "", "sword")]
ARTEFACTS = [("s0", "spec", 1), ("s0", "plan", 2), ("s0", "prose", 3), ("s1", "prose", 1), ("s1", "spec", 2), ("s1", "plan", 3), ("s2", "review", 4)]
GATES = [("s0", "spec", True), ("s0", "plan", True), ("s1", "spec", True), ("s1", "plan", False), ("s2", "plan", True)]
FILES = [("/a/x.md", "one\ntwo"), ("/a/b/y.md", "three"), ("/a/b/c/z.txt", "four"), ("/c.md", "five"), ("/ab/q.md", "six")]
WRITES = [("/a", 1, "old"), ("/a", 3, "new"), ("/b", 2, "only")]
EDITS = [("/a/x.md", 2, "2", "II"), ("/a/x.md", 1, "two", "2"), ("/a/b/y.md", 1, "absent", "!"), ("/c.md", 1, "five", "5five"), ("/c.md", 2, "absent", "")]
SETTINGS = [(1, "own", True, True, True), (2, None, False, True, None), (3, "x,y", True, False, False)]
MODELS = [(1, "cli", "env", "dflt", "sid", "new"), (2, "", "env", "dflt", "", "new"), (3, None, None, "dflt", None, "new")]
PATHS = [("/skills/a.md",), ("/skills/x/b.md",), ("/notes",), ("plain",), ("/mem/a",), ("/memory",)]
ROUTES = [("/skills/", "skills"), ("/skills/x/", "special"), ("/mem", "memory")]
BOTH_LIMITS = [("a", r, s, run, thread) for r in (1, 2) for s in (1, 2, 3) for run, thread in ((2, 3),)] + [("b", 1, 1, None, 0), ("c", 1, 1, None, None)]
FIXED_AGENTS = [(1, "writer"), (2, "reviewer")]
OWN_AGENTS = [(1, "writer", None), (2, "mine", "own")]
OLD_ROUTES, NEW_ROUTES = [("a", "old"), ("b", "old")], [("b", "new"), ("c", "new")]
PROMPTS = [(1, " mine ", "---\nname: k\n---\nbody", "map"), (2, "", "body", None), (3, None, "---\nname: k\n---\n b ", " ")]
TOOL_CALLS = [
    ("s", 1, 1, "messages", "model", "Hel", None), ("s", 1, 2, "messages", "model", "lo ", None), ("s", 1, 3, "updates", "model", None, [("task", {"subagent_type": "writer"}), ("ls", {})]),
    ("s", 1, 4, "updates", "model", None, [("task", {}), (None, {})]), ("s", 1, 5, "messages", "model", "", None), ("s", 1, 6, "messages", "tools", "hidden", None), ("s", 1, 7, "messages", "model", " ", None),
    ("s", 1, 8, "updates", "model", None, [("grep", {}), ("task", None), ("after", {})]), ("s", 1, 9, "updates", "tools", None, [("not shown", {})]), ("s", 1, 10, "messages", "model", "end", None), ("s", 1, 11, "updates", "model", None, []),
    ("s", 1, 12, "messages", "model", "!", None), ("s", 1, 13, "interrupt", None, None, None), ("s", 2, 1, "messages", "model", "again", None), ("s", 2, 2, "end", None, None, None),
]

#: The same events and their calls without arrays and maps.
EVENT_ROWS = [(*e[:6], len(e[6] or [])) for e in TOOL_CALLS]
CALL_ROWS = [(*e[:5], pos, name, args is not None, (args or {}).get("subagent_type")) for e in TOOL_CALLS for pos, (name, args) in enumerate(e[6] or [])]
ENVIRONMENT = [
    ("APP_RATE_LIMITER__MAX_BUCKET_SIZE", "7"), ("app_backend__enable_shell", "On"), ("APP_MODEL_RETRY", '{"max_retries": 5, "jitter": false}'), ("APP_MODEL_RETRY__MAX_RETRIES", "9"),
    ("APP_MODEL_CALL_LIMIT__THREAD_LIMIT", "12"), ("APP_TOOL_CALL_LIMIT__EXIT_BEHAVIOR", "continue"), ("APP_UNKNOWN", "x"), ("OTHER_PERSONAL__NAME", "nobody"),
]
FLAGS = [(1, True, True, 25, 50), (2, False, False, 25, 50), (3, None, None, 2, 9)]
SPEC_ROWS = [("s0", "character", 1, "voice", "dry\nand short"), ("s0", "character", 2, "wants", None), ("s0", "setting", 1, "place", "a pier"), ("s1", "setting", 1, "place", " ")]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, int | float):
        return repr(x)
    out = "'" + x.replace("'", "''") + "'"
    for c in sorted({c for c in x if ord(c) < 32 or ord(c) in (0x85, 0xA0, 0x2003)}):
        out = out.replace(c, f"' || chr({ord(c)}) || '")
    return out


def values(rows: list[tuple], names: str, alias: str = "t") -> str:
    """The rows as a SQL table."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS {alias}({names})"

#: Test cases of an evaluation.
GOLDENS = [(1, "A lighthouse keeper's diary", "a plan"), (2, "Line one\nline two, \"quoted\"", "a chapter"), (3, "Übung", "a review")]
#: Settings by path; one is a JSON object.
MAP_SETTINGS = [("agent.models", '{"drafter": "small", "reviewer": "large"}'), ("agent.rate", "5")]
