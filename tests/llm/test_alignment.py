"""Alignment of whole texts by both libraries, against the operator's alignment by units."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import sha

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    letters = sorted(ByteLevel.alphabet())
    printing = [c for c in letters if ord(c) < 256]
    byte_of = {c: ord(c) for c in printing}
    byte_of |= dict(zip((c for c in letters if ord(c) >= 256), (b for b in range(256) if b not in byte_of.values()), strict=True))
    return a, byte_of, sentencepiece.SentencePieceProcessor(model_file=B)


def ends(tokens: list[bytes]) -> list[int]:
    return np.cumsum([len(x) for x in tokens]).tolist()


def aligned(libraries, text: str | None):
    """Ids of both, and the groups as (A tokens, B tokens)."""
    a, byte_of, b = libraries
    if not text:
        return None
    raw = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(of_a) != raw or b"".join(of_b) != raw:
        return None
    ends_a, ends_b = ends(of_a), ends(of_b)
    links = [(x, y) for x, e in zip(ids_a, ends_a, strict=True) for y in [dict(zip(ends_b, ids_b, strict=True)).get(e)] if y is not None] if len(ids_a) < 300 else None
    where = dict(zip(ends_b, range(len(ids_b)), strict=True))
    groups, p, r = [], 0, 0
    for q, e in enumerate(ends_a):
        if e in where:
            groups.append((ids_a[p : q + 1], ids_b[r : where[e] + 1]))
            p, r = q + 1, where[e] + 1
    own = [(g[0][-1], g[1][-1]) for g in groups]
    assert links is None or links == own
    return ids_a, ids_b, groups, own


def expected(libraries, docs: list[tuple]) -> list[tuple]:
    found = [aligned(libraries, t) for _, t in docs]
    counts = Counter(p for f in found if f for p in f[3])
    most: dict = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for (k, _), f in zip(docs, found, strict=True):
        if f is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        ids_a, ids_b, groups, links = f
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((k, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha(said)))
    return sorted(out, key=repr)


def test_query(spark, odd, tables, libraries):
    from skein.llm.queries import queries

    d = tables["documents"].to_pydict()
    found = queries()["op13_token_alignment"](spark, odd)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == expected(libraries, list(zip(d["doc_id"], d["text"], strict=True)))


def awkward() -> list[tuple]:
    rnd = random.Random(11)
    letters = ["a", "b", "é", " ", "  ", "\n", "\t", " ", "▁", "é", "ß", "🎉", "1", "23", "'s", "'", ".", ",", "<s>", "<|endoftext|>", "　", "​", "İ", "the ", "and ", "\u0085", "中", "\x1c"]
    texts = ["".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(400)]
    plain = [x for x in letters if x != "▁"]
    texts += ["".join(rnd.choices(plain, k=rnd.randint(1, 60))) for _ in range(400)]
    texts += [None, "", " ", "  ", "▁", "a ▁b", "�", "\u0000", "x" * 3001, "word " * 2000, "ab" * 1_100_000]
    docs = [(i, t) for i, t in enumerate(texts)]
    return [*docs, (None, "the end"), (None, None), (7, "the end"), (7, "the end")]


@pytest.mark.parametrize("block", [1 << 21, 300])
def test_awkward_texts(spark, libraries, block):
    """Also with the counts in several blocks, and one text larger than a block of bytes."""
    from skein.llm import token_alignment

    docs = awkward()
    table = spark.createDataFrame([(k, t, "clash", "clash") for k, t in docs], "doc_id long, text string, n_a string, id string")
    rows = sorted(map(tuple, token_alignment.align_documents(table, A, B, block_pairs=block).collect()), key=repr)
    assert rows == expected(libraries, docs)
    assert sum(r[1] > 0 for r in rows) > 300 and sum(r[1] == 0 for r in rows) > 100


def test_what_is_known_changes_nothing(libraries):
    """The same texts again, and with room for a few units alone."""
    from skein.llm import token_alignment

    docs = awkward()[:300]
    data = [(t or "").encode() for _, t in docs]
    offsets = np.cumsum([0, *map(len, data)])
    flat = np.frombuffer(b"".join(data), np.uint8)
    own, small = token_alignment.Aligner(A, B), token_alignment.Aligner(A, B)
    small.spans.capacity = 10
    plain = lambda m: ([x.tolist() for x in m[0]], m[1], m[2].tolist())
    first = plain(own.measure(flat, offsets))
    assert first == plain(own.measure(flat, offsets)) == plain(small.measure(flat, offsets)) == plain(small.measure(flat, offsets))
    assert plain(own.measure(flat[:0], np.zeros(3, np.int64))) == ([[0, 0]] * 3, ["", ""], [])


def test_both_ways_to_the_first_tokenizers_ids(libraries):
    """Ranks give the ids of the tokenizers library, for each token of the vocabulary as a text too."""
    from tokenizers import Tokenizer

    from skein.llm import token_alignment

    own = Tokenizer.from_file(A)
    byte_of = token_alignment._bytes_of_letters()
    entries = {i: bytes(byte_of[c] for c in t) for t, i in own.get_vocab(with_added_tokens=False).items()}
    ranked, plain = token_alignment._ranked(A, entries), token_alignment._plain(own)
    texts = [x.decode() for x in entries.values() if x.decode("utf-8", "ignore").encode() == x] + [t for _, t in awkward() if t and len(t) < 5000]
    assert ranked(texts) == plain(texts)
    assert token_alignment._ranked(A, {0: b"other"}) is None and token_alignment._ranked("/absent.json", entries) is None


def test_ranks():
    from skein.llm import token_alignment

    rng = np.random.default_rng(2)
    for size in (1, 63, 64, 65, 1000):
        a, b = (np.append(np.flatnonzero(rng.random(size - 1) < 0.4), size - 1) + 1 for _ in range(2))
        cuts, rank_a, rank_b = token_alignment.align(a, b)
        assert cuts.tolist() == sorted({*a.tolist()} & {*b.tolist()})
        assert rank_a.tolist() == [int((a <= c).sum()) for c in cuts] and rank_b.tolist() == [int((b <= c).sum()) for c in cuts]
    assert [len(x) for x in token_alignment.align(np.zeros(0, int), np.zeros(0, int))] == [0, 0, 0]
