"""Corpus preparation: five stages over documents, each written as Parquet and read again by the next.

Quality rules drop what they reject; of documents linked by near-equal shingle sets the one with the smallest id stays;
repeated passages are cut out of the texts; documents that hold benchmark windows are dropped; the rest becomes token ids.

Every stage takes null and empty texts, null and repeated ids, ties, empty tables and extra columns of any name. Each says
below which rows it keeps; rows equal in all columns pass the second stage once and all others as often as they come. All
but the last return the columns of documents; the last returns doc_id, n_tokens, ids and the digests of ids and decoded bytes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import byte_bpe, decontaminate, jaccard, quality_rules, suffix_dedup
from skein.llm.common import discard, member_bits, member_state, saved, sifted
from skein.sources.scratch import scope, scratch_path


def _aside(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in a struct, out of reach of the names that operators give."""
    return docs.select(*needed, F.struct(*(c for c in docs.columns if c not in needed)).alias("document_rest"))


def _back(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    return df.select(*(new[c].alias(c) if c in new else F.col(f"document_rest.`{c}`").alias(c) for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged by itself; a null text is empty and has too few words. A null
    language, or one without references, is not compared."""
    whole = docs.select(F.struct("*").alias("document_rest"), "text", "lang")
    judged = quality_rules.judge(whole, carry=["document_rest"])
    # a filter on kept itself would be pushed below its steps, each of which the optimiser would then write out again
    decided = judged.select("document_rest", F.explode(F.array("kept")).alias("stays")).where("stays")
    return _back(decided, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group: that with the smallest id, of several with one id that with the smallest hash of
    its text. Of rows equal in id and text one stays, the first by all its columns as JSON. Rows whose texts are not linked
    stay, also where they share an id; so do texts without words and rows with a null id, the latter each by itself.

    Texts are not shuffled but for rows that two bitmaps leave open: what the first does not hold stays, what the first
    holds and the second does not goes.
    """
    linked = saved(jaccard.link_documents(docs, with_groups=True).where("doc_id is not null").select("doc_id", "th", "group_id"), "linked")
    one = F.min(F.struct("doc_id", "th")).alias("one")
    chosen = linked.where("group_id is not null").groupBy("group_id").agg(one).select("one.*")
    chosen = chosen.unionAll(linked.where("group_id is null").select("doc_id", "th").distinct())
    rows = linked.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    rows = saved(rows.join(chosen.withColumn("stays", F.lit(True)), ["doc_id", "th"], "left").select("doc_id", "th", "n", F.coalesce("stays", F.lit(False)).alias("stays"), F.xxhash64("doc_id", "th").alias("place")), "rows")
    out = spark.sparkContext.broadcast(member_bits(rows.where("not stays or n > 1").select("place")))
    open_ = sifted(rows.where("stays").select("place"), out)
    open_ = spark.sparkContext.broadcast(member_bits(open_))

    hashed = docs.select(F.struct("*").alias("document_rest"), "doc_id", F.xxhash64("text").alias("th"))
    place = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "th"))
    known = hashed.where("doc_id is not null").withColumn("state", member_state(place, out, open_))
    asked = known.where("state = 2").join(rows.where("stays").select("doc_id", "th"), ["doc_id", "th"], "left_semi")
    asked = asked.groupBy("doc_id", "th").agg(F.min_by("document_rest", F.to_json("document_rest")).alias("document_rest"))
    kept = known.where("state = 0").select("document_rest").unionAll(asked.select("document_rest")).unionAll(hashed.where("doc_id is null").select("document_rest"))
    return _back(kept, docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with repeated passages cut out of text, by whole characters, and n_chars counted again. A null text
    becomes empty. Passages stay where the smallest id has them, of one id the text with the smaller hash; null ids come first."""
    rest = suffix_dedup.remove_repeats(_aside(docs, "doc_id", "text"), whole_characters=True)
    text = F.col("kept").cast("string")
    return _back(rest, docs.columns, doc_id=F.col("doc_id"), text=text, n_chars=F.length(text).cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs, each row judged by itself. Items without id or text take no part."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate.decontaminate(_aside(docs, "doc_id", "text"), benchmark, carry=["text", "document_rest"])
    return _back(judged.where("not contaminated"), docs.columns, doc_id=F.col("doc_id"), text=F.col("text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row; a null text has none."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeats),
    ("decontaminate", benchmark_leaks),
    ("byte_bpe", tokens),
]

#: SQL can express neither byte runs cut out of texts nor BPE; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage returns is a table in the shared folder before the next one starts; then the
    stage's own scratch tables go, and so does the table that it has read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, path = docs, scratch_path(spark, name)
        with scope(spark):
            made = stage(spark, before, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        docs.scratch = path
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
