"""Column functions on text and on message content of mixed types (all executed by the surveyed code, unless noted)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Commands of the prompt, labels of the two message types that are shown, and the pattern of front matter.
COMMANDS = ("/exit", "/quit", "/help", "/session", "/reset")
SPEAKERS = {"human": "you>", "ai": "saga>"}
FRONT_MATTER = r"(?s)\A---\n(.*?)\n---\n"
#: ValueError and the exceptions of the standard library below it that tools meet, and what a model is told.
VALUE_ERRORS = ("ValueError", "UnicodeError", "UnicodeDecodeError", "UnicodeEncodeError", "UnicodeTranslateError", "JSONDecodeError")
FAILED = ("Tool `", "` failed: ", ". Fix the input and retry.")

_EDGE_SPACE = r"(?U)\A[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+\z"


def strip(text: Column) -> Column:
    """Without white space of any script at either end; null stays null."""
    return F.regexp_replace(text, F.lit(_EDGE_SPACE), F.lit(""))


def _blocks(content: Column, strings: str) -> Column:
    """The elements of a list, put together in order."""
    return F.array_join(F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda b: _item(b, strings)), "")


def _item(block: Column, strings: str) -> Column:
    is_text = F.try_variant_get(block, "$.type", "string") == "text"
    text = F.coalesce(F.try_variant_get(block, "$.text", "string"), F.lit(""))
    own = F.try_variant_get(block, "$", "string") if strings == "kept" else F.lit("")
    return F.when(F.schema_of_variant(block) == "STRING", own).when(is_text, text).otherwise(F.lit(""))


def extract_text(content: Column) -> Column:
    """The text of variant content: a string as it is; of a list the strings and the text blocks, in order; else "".

    A text block with a missing or null text adds "". Null content gives "".
    """
    kind = F.schema_of_variant(content)
    return F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(kind.startswith("ARRAY"), _blocks(content, "kept")).otherwise(F.lit(""))


def text_blocks(content: Column) -> Column:
    """As extract_text, but the strings of a list are left out."""
    kind = F.schema_of_variant(content)
    return F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(kind.startswith("ARRAY"), _blocks(content, "dropped")).otherwise(F.lit(""))


def speaker(kind: Column) -> Column:
    """The label in front of a shown message; null for types that are not shown."""
    out = F.lit(None).cast("string")
    for name, label in SPEAKERS.items():
        out = F.when(kind == name, label).otherwise(out)
    return out


def tool_label(call: Column) -> Column:
    """`dispatching <subagent>` for the task tool (`?` without one), else the tool's name, `tool` without one."""
    name = F.coalesce(call["name"], F.lit("tool"))
    agent = F.coalesce(F.element_at(call["args"], "subagent_type"), F.lit("?"))
    return F.when(name == "task", F.concat(F.lit("dispatching "), agent)).otherwise(name)


def command(text: Column) -> Column:
    """The command that a line is after stripping: exact and case-sensitive; `message` for other text, null if blank."""
    bare = strip(text)
    return F.when(bare.isin(*COMMANDS), bare).when(bare != "", F.lit("message"))


def tool_error(tool: Column, error: Column, bases: Column | None = None) -> Column:
    """What a model is told of a tool's ValueError, by name only; null for errors that propagate. An error counts if it or
    one of its bases (an array of class names, where they were logged) is a ValueError."""
    told = error.isin(*VALUE_ERRORS)
    if bases is not None:
        told = told | F.coalesce(F.arrays_overlap(bases, F.array(*map(F.lit, VALUE_ERRORS))), F.lit(False))
    return F.when(told, F.concat(F.lit(FAILED[0]), tool, F.lit(FAILED[1]), error, F.lit(FAILED[2])))


def strip_front_matter(text: Column) -> Column:
    """Markdown without its leading `---` block, stripped. The closing fence needs a line end after it."""
    return strip(F.regexp_replace(text, F.lit(FRONT_MATTER), F.lit("")))


def front_matter_field(text: Column, name: str) -> Column:
    """One field of the front matter, "" where it is missing."""
    return F.regexp_extract(F.regexp_extract(text, FRONT_MATTER, 1), rf"(?m)^{name}: (.*)$", 1)


def utc_text(epoch_seconds: Column) -> Column:
    """Epoch seconds as `YYYY-MM-DD HH:MM:SS` in UTC, whatever the session's zone."""
    since = F.make_dt_interval(secs=epoch_seconds.cast("decimal(18,6)"))
    return F.substring((F.expr("timestamp_ntz'1970-01-01 00:00:00'") + since).cast("string"), 1, 19)


def uuid7_millis(identifier: Column) -> Column:
    """The epoch milliseconds in a time-ordered UUID; null for any other name."""
    digits = F.conv(F.substring(F.replace(identifier, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")
    return F.when(identifier.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), digits)


def uuid7() -> Column:
    """A new time-ordered UUID for each row: 48 bits of milliseconds, version 7, variant 10, the rest random."""
    millis = "lpad(lower(hex(unix_millis(current_timestamp()))), 12, '0')"
    return F.expr(f"concat(substr({millis}, 1, 8), '-', substr({millis}, 9, 4), '-7', substr(uuid(), 16, 3), '-', substr(uuid(), 20, 4), '-', substr(uuid(), 25, 12))")


def first_set(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def sections(*parts: Column) -> Column:
    """Those parts that are not blank, stripped, with an empty line between them."""
    return F.concat_ws("\n\n", *(F.nullif(strip(p), F.lit("")) for p in parts))


def merge_maps(old: Column, new: Column) -> Column:
    """Both maps' entries; where a key is in both, the old entry wins."""
    return F.map_concat(F.map_filter(new, lambda k, _: ~F.map_contains_key(old, k)), old)
