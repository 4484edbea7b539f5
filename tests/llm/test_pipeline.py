"""The pipeline's stages against brute-force versions, each on what the stage before it kept."""

from __future__ import annotations

import base64
import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
from brute import base_counts, contamination, link_rows, removed


def whole_characters(raw: bytes, gone: np.ndarray) -> str:
    out, at = [], 0
    for c in raw.decode():
        size = len(c.encode())
        if not gone[at : at + size].any():
            out.append(c)
        at += size
    return "".join(out)


def test_stages(spark, odd, tables, tmp_path):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        stage(spark, docs, odd).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = before, {r["doc_id"]: r.asDict() for r in docs.collect()}
        assert name == "byte_bpe" or docs.columns == columns

    before, after = kept["quality_rules"]
    failed = {k for k, r in before.items() if base_counts(r["text"] or "")["base_failed"]}
    assert after.keys() <= before.keys() - failed and len(after) > len(before) / 3
    assert all(after[k] == before[k] for k in after)

    before, after = kept["jaccard_join"]
    assert after == {k: before[k] for k, r in link_rows({k: r["text"] for k, r in before.items()}).items() if r["component_id"] == k}
    assert len(after) < len(before)

    before, after = kept["suffix_dedup"]
    gone = removed([(k, r["text"].encode()) for k, r in before.items()])
    texts = {k: whole_characters(r["text"].encode(), gone[k]) for k, r in before.items()}
    assert after == {k: r | {"text": texts[k], "n_chars": len(texts[k])} for k, r in before.items()}

    before, after = kept["decontaminate"]
    b = tables["benchmark"]
    items = [(str(i), t) for i, t in zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True) if i is not None and t]
    found = contamination({k: r["text"] for k, r in before.items()}, items)
    assert after == {k: r for k, r in before.items() if not found[k]["contaminated"]}

    import tiktoken

    before, after = kept["byte_bpe"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {k: r["ids"] for k, r in after.items()} == {k: own.encode_ordinary(r["text"]) for k, r in before.items()}


def test_run(spark, odd, empty):
    rows = corpus_pipeline.run(spark, odd).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in spark.read.parquet(f"{odd}/documents.parquet").collect()}
    assert corpus_pipeline.run(spark, empty).collect() == []


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int = 120) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(n))


def shared() -> list[tuple]:
    """Ids on two texts, repeated rows, null ids and texts, and rows that differ in another column alone."""
    a, q, z = words(1), words(2), words(3)
    near = a.replace(a.split()[60], "changed", 1)
    texts = [(1, a), (5, near), (5, z), (7, q), (7, q), (8, q), (9, None), (9, None), (9, ""), (10, ""), (None, a), (None, a), (11, "two words"), (12, "two words"), (5, words(4))]
    return [(k, t, "en", "s", None if t is None else len(t)) for k, t in texts] + [(7, q, "en", "another", len(q))]


def test_near_duplicates_by_row(spark):
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(shared(), SCHEMA), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    a, q, z = words(1), words(2), words(3)
    expected = [(1, a, "s"), (5, z, "s"), (5, words(4), "s"), (7, q, "another"), (9, None, "s"), (9, "", "s"), (10, "", "s"), (None, a, "s"), (None, a, "s"), (11, "two words", "s")]
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect()) == Counter(expected)


def test_stages_on_repeated_rows_and_null_keys(spark, odd):
    docs = spark.createDataFrame(shared(), SCHEMA)
    rows = Counter(map(tuple, docs.collect()))
    kept = Counter(map(tuple, corpus_pipeline.quality(spark, docs, odd).collect()))
    assert kept == Counter({r: n for r, n in rows.items() if r[1] and len(r[1].split()) >= 50})
    kept = Counter(map(tuple, corpus_pipeline.benchmark_leaks(spark, docs, odd).collect()))
    assert kept == rows  # no row holds a window
    cut = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.repeats(spark, docs, odd).collect())
    a, q = words(1), words(2)
    assert cut[(None, a)] == 2 and cut[(1, "")] == 1 and cut[(7, q)] == 3 and cut[(8, "")] == 1 and cut[(9, "")] == 3 and cut[(11, "two words")] == 1
    out = Counter((r["doc_id"], r["n_tokens"] > 0) for r in corpus_pipeline.tokens(spark, docs, odd).collect())
    assert out == Counter((k, bool(t)) for k, t, *_ in shared())


def test_scratch_of_the_stages_goes(spark, odd):
    from skein.sources.scratch import scratch_path

    folder = Path(scratch_path(spark, "any").removeprefix("file://")).parent
    before = {*folder.iterdir()} if folder.exists() else set()
    assert corpus_pipeline.run(spark, odd).count()
    assert [p.name.split("-")[0] for p in {*folder.iterdir()} - before] == ["decontaminate"]
