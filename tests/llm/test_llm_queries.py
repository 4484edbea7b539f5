"""Each query against a brute-force version, over the odd tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import LOWER, base_counts, contamination, differing, link_rows, removal_row, removed, sha

@pytest.mark.parametrize("name", ["op1_toxicity", "op8_quality_model"])
def test_scores(ask, texts, name):
    rows = ask(name)
    assert set(rows) == set(texts)
    limit = 0.3 if name.startswith("op1") else 0.7
    for k, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)
    by_text = defaultdict(set)
    for k, t in texts.items():
        by_text[t].add(rows[k]["score"])
    assert all(len(s) == 1 for s in by_text.values())


def test_quality_rules(ask, texts):
    rows = ask("op2_quality_rules")
    assert not differing(rows, {k: base_counts(t) for k, t in texts.items()})
    assert not any(r["kept"] and r["base_failed"] for r in rows.values())
    assert sum(r["kept"] for r in rows.values()) > 30


def test_byte_bpe(ask, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {k: own.encode_ordinary(t) for k, t in texts.items()}
    assert not differing(ask("op3_byte_bpe"), {k: {"n_tokens": len(i), "ids_sha256": sha(",".join(map(str, i))), "decoded_sha256": sha(texts[k])} for k, i in ids.items()})


def test_suffix_dedup(ask, texts):
    gone = removed([(k, t.encode()) for k, t in texts.items()])
    assert not differing(ask("op4_suffix_dedup"), {k: removal_row(t.encode(), gone[k]) for k, t in texts.items()})


def test_warc(ask, tables):
    pages = {k: (h or "").encode() for k, h in zip(tables["pages"]["page_id"].to_pylist(), tables["pages"]["html"].to_pylist(), strict=True)}
    last = {}
    for k in sorted(pages):
        last[pages[k]] = k
    expected = {}
    for k, raw in pages.items():
        again = len(raw) >= 1000 and last[raw] != k
        expected[k] = {"payload_bytes": len(raw), "payload_digest": hashlib.sha1(raw).hexdigest(), "record_type": "revisit" if again else "response", "refers_to": last[raw] if again else None}
    assert any(e["refers_to"] for e in expected.values())
    assert not differing(ask("op5_warc", "page_id"), expected)


def test_jaccard_join(ask, texts):
    assert not differing(ask("op6_jaccard_join"), link_rows(texts))


RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def test_url_filter(ask, tables):
    rows = ask("op7_url_filter", "page_id")
    for k, url in zip(tables["pages"]["page_id"].to_pylist(), tables["pages"]["url"].to_pylist(), strict=True):
        host = path = ""
        if url and "://" in url:
            rest = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
            host, slash, path = rest.partition("/")
            host, path = host.translate(LOWER), slash + path
        fits = [r for r in RULES if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        rule = max(fits, key=len, default=None)
        assert (rows[k]["host"], rows[k]["path"], rows[k]["rule"]) == (host, path, rule), url
        assert rows[k]["verdict"] in ("allow", "block") and (rule is None or rows[k]["verdict"] == RULES[rule])


def test_decontaminate(ask, texts, tables):
    b = tables["benchmark"]
    items = [(str(i), t) for i, t in zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True) if i is not None and t]
    expected = contamination(texts, items)
    assert sum(e["contaminated"] for e in expected.values()) > 3
    assert not differing(ask("op9_decontaminate"), expected)


def test_token_output(ask, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, start = {}, 0
    for k in sorted(texts):
        ids = np.array([*own.encode(texts[k], add_special_tokens=False).ids, 1], "<u4")
        expected[k] = {"start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)
    assert not differing(ask("op10_token_output"), expected)


def test_empty_tables(spark, empty):
    from skein.llm.queries import queries

    for name, query in queries().items():
        if name != "pipeline":
            assert query(spark, empty).collect() == [], name
