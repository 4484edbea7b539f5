"""Every operator on null ids and texts, repeated rows, one id on several texts, texts larger than a block of bytes, and
columns of clashing names in all tables; rows are compared as they come, not by id."""

from __future__ import annotations

import base64
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from brute import BENCHMARK_WORD, LOWER, base_counts, contamination, removal_row, removed, sha, shingles

CLASH = ("id", "th", "h", "doc", "node", "place", "kept", "score", "label", "item", "rest")


def say(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs() -> list[tuple]:
    long = say(9, 500_000)  # about 3 MB
    assert len(long) > 1 << 21
    rows = [(1, say(1, 200)), (2, say(1, 200)), (3, None), (3, None), (4, ""), (5, say(2, 90)), (5, say(2, 90)), (5, say(3, 90)), (6, "x" * 2_300_001), (7, long), (8, say(4, 30) + " the toxic part " + say(5, 30)), (12, say(6, 8))]
    return [*rows, (None, say(7, 100)), (None, None), (None, say(7, 100))]


@pytest.fixture(scope="module")
def table(spark, docs):
    names = ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(k, t, "en", "s", *["clash"] * len(CLASH)) for k, t in docs], f"doc_id long, text string, lang string, source string, {names}").repartition(3)


def rows(df, *columns: str) -> Counter:
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_quality_rules(table, docs):
    from skein.llm import quality_rules

    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = rows(quality_rules.judge(table.drop("kept"), carry=["doc_id"]), "doc_id", *columns)
    assert found == Counter((k, *(base_counts(t or "")[c] for c in columns)) for k, t in docs)


def test_byte_bpe(table, docs):
    import tiktoken
    from skein.llm import byte_bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {t: own.encode_ordinary(t or "") for _, t in docs}
    found = rows(byte_bpe.encode_documents(table.drop("id"), path, public_tokenizers.PATTERN, with_ids=False), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found == Counter((k, len(ids[t]), sha(",".join(map(str, ids[t]))), sha(t or "")) for k, t in docs)


def test_suffix_dedup(table, docs):
    from skein.llm import suffix_dedup

    # null ids come first; the order of rows of one id does not show, as they share no passage unless they are equal
    each = sorted({(-1 if k is None else k, t or "") for k, t in docs})
    gone = removed([(i, t.encode()) for i, (_, t) in enumerate(each)])
    expected = {(k, t): removal_row(t.encode(), gone[i]) for i, (k, t) in enumerate(each)}
    columns = ["n_bytes", "n_removed", "n_spans"]
    found = rows(suffix_dedup.remove_repeats(table), "doc_id", *columns)
    assert found == Counter((k, *(expected[-1 if k is None else k, t or ""][c] for c in columns)) for k, t in docs)
    assert found[2, len(say(1, 200)), len(say(1, 200)), 1] == 1


def test_jaccard(table, docs):
    from skein.llm import jaccard

    sets = [shingles(t or "") for _, t in docs]
    least = {}
    for (k, _), s in zip(docs, sets, strict=True):
        if k is not None and s:
            least[frozenset(s)] = min(k, least.get(frozenset(s), k))
    expected = Counter((k, len(s), None if k is None else least[frozenset(s)] if s else k) for (k, _), s in zip(docs, sets, strict=True))
    assert rows(jaccard.link_documents(table), "doc_id", "n_shingles", "component_id") == expected


def test_decontaminate(spark, table, docs, monkeypatch):
    """Also with the benchmark in many blocks, items repeated, and items without id or text."""
    from skein.llm import decontaminate

    words = BENCHMARK_WORD.findall(docs[9][1].translate(LOWER))
    items = [(1, " ".join(words[499_000:499_020])), (1, " ".join(words[499_000:499_020])), (2, "the toxic part"), (3, say(2, 90)), (4, None), (None, "the toxic part"), (5, " "), (6, "xyz")] + [(i, say(100 + i, 12)) for i in range(10, 40)]
    benchmark = spark.createDataFrame([(*x, "clash", "clash", 7) for x in items], "item_id long, text string, item string, doc_id string, block int")
    texts = {i: t or "" for i, (_, t) in enumerate(docs)}
    found = contamination(texts, [(str(k), t) for k, t in items if k is not None and t])
    expected = Counter((docs[i][0], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for i, r in found.items())
    for size in (decontaminate.BLOCK_ITEM_BYTES, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEM_BYTES", size)
        blocks = [*decontaminate._blocks_of(benchmark, "item_id", "text")]
        assert sorted(x for b in blocks for x in b) == sorted({(str(k), t) for k, t in items if k is not None and t is not None})
        assert (len(blocks) > 5) == (size == 300) and all(sum(len(t) for _, t in b[:-1]) < size for b in blocks)
        assert rows(decontaminate.decontaminate(table.drop("item"), benchmark), "doc_id", "n_words", "n_hit", "n_items", "contaminated") == expected
    assert sum(n for r, n in expected.items() if r[4]) >= 4
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(table, benchmark.limit(0)).collect())


def test_token_output(spark, table, docs, tmp_path):
    from skein.llm import token_output
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, start, expected = Tokenizer.from_file(path), 0, []
    for k, t in sorted(docs, key=lambda d: (-1 if d[0] is None else d[0], d[1] or "")):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    token_output.write_tokens(table, str(tmp_path / "t"), path, end=1)
    assert rows(token_output.read_tokens(spark, str(tmp_path / "t")), "doc_id", "start", "n_tokens", "ids_crc32") == Counter(expected)


def test_pages(spark, tmp_path):
    """Repeated rows, null ids, and columns named like results, for archives and URL rules."""
    from skein.llm import url_filter, warc

    pages = [(1, "http://www.example.com/en/a", "p" * 2000), (2, "http://a.example.com/en/", "p" * 2000), (2, "http://a.example.com/en/", "p" * 2000), (None, None, None), (3, "http://net/es/", "q" * 3_000_000), (None, "http://x.net/fr/", "r")]
    table = spark.createDataFrame([(*p, "clash", "clash", "clash") for p in pages], "page_id long, url string, html string, host string, digest string, key string")
    judged = rows(url_filter.filter_urls(table), "page_id", "host", "rule", "verdict")
    assert judged == Counter({(1, "www.example.com", "www.example.com/en/", "allow"): 1, (2, "a.example.com", "example.com/en/", "block"): 2, (None, "", None, "allow"): 1, (3, "net", "net/es/", "block"): 1, (None, "x.net", "net/fr/", "block"): 1})
    warc.write_warc(table, f"{tmp_path}/w")
    read = rows(warc.read_warc(spark, f"{tmp_path}/w"), "page_id", "payload_bytes", "record_type", "refers_to")
    assert read == Counter({(1, 2000, "revisit", 2): 1, (2, 2000, "response", None): 2, (None, 0, "response", None): 1, (3, 3_000_000, "response", None): 1, (None, 1, "response", None): 1})


@pytest.mark.parametrize("name", ["toxicity", "quality_model"])
def test_models_on_awkward_rows(spark, table, docs, name):
    import importlib

    module = importlib.import_module(f"skein.llm.{name}")
    texts = [(i, f"{'vile rotten filth ' if i % 2 else 'kind gentle words '}{say(i, 60)}{' #$%' * (i % 2) * 30}") for i in range(80)]
    train_on = spark.createDataFrame([(k, t, "clash") for k, t in texts], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2, "clash") for i in range(80)] + [(0, 1, 1, "x"), (None, 1, 0, "x"), (5, None, None, "x")], "doc_id long, toxic int, quality int, id string")
    model = module.train(labels, train_on)
    scored = module.score(table, model)
    assert rows(scored, "doc_id") == Counter((k,) for k, _ in docs)
    by = {r["doc_id"]: r["score"] for r in module.score(train_on, model).collect()}
    good = np.mean([by[i] for i in range(0, 80, 2)]) - np.mean([by[i] for i in range(1, 80, 2)])
    assert (good < -0.3) if name == "toxicity" else (good > 0.3)
    assert all(0 <= r["score"] <= 1 for r in scored.collect())
    for some in (labels.limit(0), labels.where("toxic = 1 and doc_id > 0"), labels.where("toxic = 0 and doc_id > 0")):
        flat = module.train(some, train_on)
        assert len({r["score"] for r in module.score(table, flat).collect()}) == 1
    assert module.score(table.limit(0), model).collect() == []


def test_log_count_ratios(spark, monkeypatch):
    """The scale of each n-gram, by hand, from texts that hold it; weights of 1 instead of fitted ones."""
    from skein.llm import toxicity

    bad, fine = ["zzz vile", "vile zzz", "so vile zzz", "vile", "very vile zzz"] * 4, ["so kind", "kind words", "very kind", "so so", "words"] * 4
    rows_ = [(i, t) for i, t in enumerate(bad + fine)]
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y, w: (np.ones(len(x.scale)), 0.0))
    monkeypatch.setattr(toxicity, "LEAST_Z", 3.0)
    labels = spark.createDataFrame([(i, int(i < len(bad))) for i in range(len(rows_))], "doc_id long, toxic int")
    model = toxicity.train(labels, spark.createDataFrame(rows_, "doc_id long, text string"))
    value = dict(zip(model.buckets.tolist(), model.values.tolist(), strict=True))
    grams = lambda t: {t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}
    bucket = lambda g: int(next(b for b, _ in toxicity.ngram_buckets([g]) if len(b))[0])
    s = toxicity.SMOOTHING
    for g in ("vil", "ile", "vile", "kin", "kind"):
        p, q = sum(g in grams(t) for t in bad), sum(g in grams(t) for t in fine)
        expected = np.log((p + s) / (q + s)) - np.log((len(bad) + 2 * s) / (len(fine) + 2 * s))
        assert value[bucket(g)] == pytest.approx(expected)
    assert bucket("so ") not in value


def test_sparse_products():
    from skein.llm import toxicity

    rng = np.random.default_rng(1)
    dense = rng.random((30, 12)) < 0.3
    dense[4] = False
    scale = rng.normal(size=12)
    x = toxicity.Presence(np.nonzero(dense)[1], dense.sum(axis=1), scale)
    v, u = rng.normal(size=12), rng.normal(size=30)
    assert np.allclose(x.by_text(v), (dense * scale) @ v) and np.allclose(x.by_feature(u), (dense * scale).T @ u)


def test_flat_trees_against_a_walk():
    from skein.llm import quality_model as q

    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5))
    x[:100, 2] = x[100:200, 2]
    y = (x[:, 0] + x[:, 2] * x[:, 3] > 0.2).astype(float)
    trees = q.grow(x, y, np.ones(len(x)))

    def walk(node: int, row: np.ndarray) -> float:
        if trees.left[node] == node:
            return trees.value[node]
        return walk(trees.left[node] if row[trees.feature[node]] <= trees.cut[node] else trees.right[node], row)

    some = np.vstack([x[:80], rng.normal(size=(40, 5)) * 3])
    expected = [1 / (1 + np.exp(-(trees.bias + sum(walk(int(r), row) for r in trees.roots)))) for row in some]
    assert np.allclose(trees.score(some), expected, rtol=1e-12)
    assert ((trees.score(x) > 0.5) == (y == 1)).mean() > 0.9
