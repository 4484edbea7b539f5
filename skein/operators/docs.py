"""Stored documents: (path, text), with seq where several writes of a path are kept. The contracts are those of the
surveyed call sites; their implementation is not in the tree."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: lines that a read returns unless told otherwise.
LINES = 100


def lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    return files.select(F.col(path), F.posexplode(F.split(F.col(text), "\n")).alias("line", "content"))


def read_lines(files: DataFrame, offset: int = 0, limit: int = LINES, path: str = "path", text: str = "text") -> DataFrame:
    """limit lines of each file from offset on, with their numbers: slices before it explodes."""
    some = F.slice(F.split(F.col(text), "\n"), offset + 1, limit)
    return files.select(F.col(path), F.posexplode(some).alias("k", "content")).select(path, (F.col("k") + offset).alias("line"), "content")


def grep(files: DataFrame, pattern: str, path: str = "path", text: str = "text") -> DataFrame:
    """Lines that the pattern is found in. Whole texts are filtered first, unless the pattern has groups with options or looks
    for the ends of its input, which lines have and texts have not."""
    if not re.search(r"\(\?|\\[AzZG]", pattern):
        files = files.where(F.col(text).rlike(f"(?m){pattern}"))
    return lines(files, path, text).where(F.col("content").rlike(pattern))


def ls(files: DataFrame, directory: str, path: str = "path") -> DataFrame:
    """Names right below a directory; a folder's name ends with a slash."""
    prefix = directory.rstrip("/") + "/"
    rest = F.substring(F.col(path), len(prefix) + 1, 1 << 30)
    name = F.when(F.instr(rest, "/") > 0, F.concat(F.substring_index(rest, "/", 1), F.lit("/"))).otherwise(rest)
    return files.where(F.col(path).startswith(prefix)).select(name.alias("name")).distinct()


def glob_pattern(glob: str) -> str:
    """A regular expression: `**/` any folders, `**` anything, `*` and `?` within a name."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(p, re.escape(p)) for p in re.split(r"(\*\*/|\*\*|\*|\?)", glob)) + "$"


def glob(files: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    return files.where(F.col(path).rlike(glob_pattern(pattern))).select(path)


def latest_writes(writes: DataFrame) -> DataFrame:
    """The text of each path after all its writes: the last one wins, of several at one seq the greatest text."""
    return writes.groupBy("path").agg(F.max_by("text", F.struct("seq", "text")).alias("text"))


def edit(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Exact replacement: the edits (path, seq, old, new) of a path one after the other, by seq and then by old and new, all
    occurrences each; edited says if one of them found its text. A row for each file."""
    steps = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "old", "new"))).alias("steps"))

    def applied(state, step):
        found = F.coalesce((step["old"] != "") & F.contains(state["text"], step["old"]), F.lit(False))
        return F.struct(F.when(found, F.replace(state["text"], step["old"], F.coalesce(step["new"], F.lit("")))).otherwise(state["text"]).alias("text"), (state["edited"] | found).alias("edited"))

    start = F.struct(F.col("text").alias("text"), F.lit(False).alias("edited"))
    done = F.aggregate(F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)), start, applied)
    return files.join(steps, "path", "left").select("path", done.alias("done")).select("path", "done.text", "done.edited")


def style(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Measures of style that the survey lists as described but never computed; the definitions are ours."""
    rows = files.select(path, F.col(text).alias("text"), _words(F.col(text)).alias("words"))
    found = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    return rows.select(path, F.size("words").cast("long").alias("n_words"), found(r"[.!?]").alias("n_sentences"), found(r"\?").alias("n_questions"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")


def _sizes(text: Column, end: str) -> Column:
    """Words in each part of a text between ends, parts without a word left out."""
    return F.filter(F.transform(F.split(text, end), lambda part: F.size(_words(part)).cast("long")), lambda n: n > 0)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a + n)


def style_shape(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The rest of the survey's notions of style, in our definitions: mean characters of a word, sentences (parts between
    `.`, `!` and `?` that hold a word) with the longest and the variance of their words, marks of punctuation for each
    character, and paragraphs (parted by empty lines) with the longest. Without words the means are null; all of a null
    text is null."""
    rows = files.select(path, F.col(text).alias("text"), _words(F.col(text)).alias("words"), _sizes(F.col(text), r"[.!?]").alias("sentences"), _sizes(F.col(text), r"\n\n+").alias("paragraphs"))
    chars = _sum(F.transform("words", lambda w: F.length(w).cast("long")))
    sums = rows.select(path, F.size("words").cast("long").alias("n"), chars.alias("word_chars"), F.size("sentences").cast("long").alias("n_sentences"), F.array_max("sentences").alias("longest_sentence"), _sum(F.col("sentences")).alias("s1"), _sum(F.transform("sentences", lambda n: n * n)).alias("s2"), F.regexp_count("text", F.lit(r"[,;:.!?]")).alias("marks"), F.length("text").alias("chars"), F.size("paragraphs").cast("long").alias("n_paragraphs"), F.array_max("paragraphs").alias("longest_paragraph"))
    of = lambda a, b: F.expr(f"try_divide(cast({a} as double), cast({b} as double))")
    return sums.select(path, of("word_chars", "n").alias("mean_word_chars"), "n_sentences", "longest_sentence", of("n_sentences * s2 - s1 * s1", "n_sentences * n_sentences").alias("sentence_variance"), of("marks", "chars").alias("mark_share"), "n_paragraphs", "longest_paragraph")
