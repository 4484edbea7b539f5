"""Quality rules on native columns: base counts, and divergence from language references.

A text's histogram over character classes and its histogram over its languages' common words are compared with
references by the Jensen-Shannon distance (the root of the divergence in bits, 0 to 1). The references are the mean
histograms of the corpus's own documents in each language, over all of them. A text is held against the closest language;
one too short for a histogram to mean much is not judged by it.

Everything is DataFrame and SQL functions over one row at a time. The counts and histograms are taken once, into a table of
the shared folder; means and distances are read from it. The only shuffle is the mean of the references, a row for each
language and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it was for on are as with be".split(),
    "de": "der die und in den von zu das mit sich des auf ist im ein eine".split(),
    "fr": "de la le et les des en un une du que pour dans est par pas".split(),
    "es": "de la que el en y los se del las un por con no una su".split(),
}
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
#: Least code points for the class histogram and least words for the word histogram.
LEAST_CHARS, LEAST_WORDS = 200, 150
#: Distances beyond which a text is rejected.
MOST_CLASSES, MOST_WORDS = 0.26, 0.25
BASE_WORDS, BASE_REPEATS = 50, 50

_WHITE = r"[\\x20\\x09-\\x0D]++"


#: One character for each common word, so that a text's common words are a short string in which each is easily counted.
_CODES = {w: chr(0x30 + i) for i, w in enumerate(WORDS)}
_RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def measure(documents: DataFrame, text: str = "text", lang: str = "lang", carry: Sequence[str] | None = None) -> DataFrame:
    """For each row: carried (a struct of the columns to carry, all by default), lang, the code points n_points, the base
    counts and both histograms, classes and common. No name of a document's column can clash with these."""
    carried = F.struct(*(F.col(f"`{c}`") for c in (documents.columns if carry is None else carry)))
    df = documents.select(carried.alias("carried"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = df.withColumn("words", F.expr(f"array_remove(split(text, '{_WHITE}'), '')")).withColumn("n", F.size("words").cast("long"))
    # each step leaves less text: what is left after the letters a-z is short, and the other classes are counted in it
    left = "text"
    sizes = [F.length(left)]
    for k, kind in enumerate(("[a-z]++", _WHITE, "[A-Z]++", "[0-9]++", "[#*$%&|<>]++", r"[\\x00-\\x7F]++")):
        df = df.withColumn(f"left{k}", F.expr(f"regexp_replace({left}, '{kind}', '')"))
        left = f"left{k}"
        sizes.append(F.length(left))
    df = df.withColumn("sizes", F.array(*sizes))
    classes = F.expr("concat(transform(slice(sizes, 1, 6), (x, i) -> x - sizes[i + 1]), slice(sizes, 7, 1))")
    codes = F.create_map(*(F.lit(x) for pair in _CODES.items() for x in pair))
    df = df.withColumn("known", F.expr("filter(words, w -> w in (" + ", ".join(f"'{w}'" for w in WORDS) + "))"))
    df = df.withColumn("said", F.array_join(F.transform("known", lambda w: F.element_at(codes, w)), ""))
    common = F.array(*(F.length("said") - F.length(F.replace("said", F.lit(c))) for c in _CODES.values()), F.col("n").cast("int") - F.length("said"))
    lines = F.expr(r"filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')")
    # 3-word windows: hash, then place; equal hashes stand together after the sort
    df = df.withColumns({"classes": classes, "common": common, "lines": lines, "runs": F.expr("transform(slice(words, 1, greatest(0, size(words) - 2)), (w, i) -> xxhash64(w, words[i + 1], words[i + 2]))")})
    df = df.withColumn("sorted", F.expr("CASE WHEN size(array_distinct(runs)) < size(runs) THEN array_sort(transform(runs, (h, i) -> struct(h AS h, i AS i))) ELSE cast(array() AS array<struct<h:bigint,i:int>>) END"))
    df = df.withColumn("again", F.expr("array_sort(transform(filter(sorted, (x, k) -> x.h = get(sorted, k - 1).h OR x.h = get(sorted, k + 1).h), x -> x.i))"))
    repeat = F.expr("aggregate(again, struct(0L AS n, -3 AS last), (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n)")
    return df.select(
        "carried",
        "lang",
        F.length("text").alias("n_points"),
        F.col("n").alias("n_words"),
        (F.length("text") - F.col("classes")[1]).cast("long").alias("word_chars"),
        F.col("classes")[4].cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        "classes",
        "common",
    )


def _shares(column: str, total: str) -> Column:
    """A histogram as shares of its sum; all 0 if that is 0."""
    return F.transform(column, lambda x: x / F.greatest(F.lit(1), F.col(total)))


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """For each language of COMMON_WORDS that measured rows have: the mean class and word histograms. Texts too short to be
    judged, and those without a language, take no part; repeated rows count as often as they stand there; of an empty
    table there are no references."""
    df = measured.where(F.col("lang").isin(list(COMMON_WORDS)) & (F.col("n_words") >= LEAST_WORDS) & (F.col("n_points") >= LEAST_CHARS))
    df = df.select("lang", _shares("classes", "n_points").alias("c"), _shares("common", "n_words").alias("w"))
    means = [F.avg(F.col("c")[i]).alias(f"c{i}") for i in range(7)] + [F.avg(F.col("w")[i]).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    return {r["lang"]: (list(r[1:8]), list(r[8:])) for r in df.groupBy("lang").agg(*means).collect()}


def _distance(column: str, reference: list[float]) -> str:
    other = "array(" + ", ".join(f"{x!r}D" for x in reference) + ")"
    half = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / (p + r)) ELSE 0D END"
    return f"sqrt(greatest(0D, aggregate(zip_with({column}, {other}, (p, r) -> {half('p')} + {half('r')}), 0D, (a, x) -> a + x) / 2))"


def judged(measured: DataFrame, refs: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """The carried columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance (null where not judged) and kept. A carried column with the name of a result gives way to it."""
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))
    df = measured.withColumns({"p_classes": _shares("classes", "n_points"), "p_common": _shares("common", "n_words"), "base_failed": base})
    never = F.lit(None).cast("double")
    if refs:
        known = F.col("lang").isNull() | F.col("lang").isin(list(refs))
        smallest = lambda column, k: F.expr("array_min(array(" + ", ".join(_distance(column, r[k]) for r in refs.values()) + "))")
        classes, words = F.when(known & (F.col("n_points") >= LEAST_CHARS), smallest("p_classes", 0)), F.when(known & (F.col("n_words") >= LEAST_WORDS), smallest("p_common", 1))
    else:
        classes = words = never
    df = df.withColumns({"class_distance": classes, "word_distance": words})
    df = df.withColumn("kept", ~F.col("base_failed") & (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CLASSES) & (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORDS))
    own = [c for c in measured.schema["carried"].dataType.names if c not in _RESULTS]
    return df.select(*(F.col(f"carried.`{c}`").alias(c) for c in own), *_RESULTS)


def judge(documents: DataFrame, text: str = "text", lang: str = "lang", carry: Sequence[str] | None = None) -> DataFrame:
    """The documents' columns (those in carry, all by default) with the results of judged(), against references from the
    same documents.

    A null or empty text has no words and so fails the base rule. A text whose language is set but has no reference, or
    where there are no references, is judged by the base rule alone. Repeated rows repeat; an empty table gives an empty
    one. Columns of the documents with the names of results are replaced.
    """
    measured = saved(measure(documents, text, lang, carry), "measures")
    return judged(measured, references(measured))
