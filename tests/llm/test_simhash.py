"""SimHash: fingerprints by the definition, links against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from brute import LOWER, WORD


def fingerprint(text: str | None) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int]) -> dict[int, int]:
    """The smallest fingerprint reachable from each, by comparing all pairs."""
    every = sorted(set(prints))
    root = {x: x for x in every}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(every):
        for y in every[i + 1 :]:
            if (x ^ y).bit_count() <= 3:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {x: find(x) for x in every}


def expected(docs: list[tuple]) -> list[tuple]:
    prints = [fingerprint(t) for _, t in docs]
    root = components([p for p, (k, _) in zip(prints, docs, strict=True) if k is not None])
    least: dict[int, int] = {}
    for p, (k, _) in zip(prints, docs, strict=True):
        if k is not None:
            least[root[p]] = min(k, least.get(root[p], k))
    return sorted(((k, f"{p:016x}", None if k is None else least[root[p]]) for p, (k, _) in zip(prints, docs, strict=True)), key=repr)


def test_query(spark, odd, tables):
    from skein.llm.queries import queries

    d = tables["documents"].to_pydict()
    rows = queries()["op12_simhash"](spark, odd).collect()
    assert sorted(map(tuple, rows), key=repr) == expected(list(zip(d["doc_id"], d["text"], strict=True)))
    assert any(r["doc_id"] != r["component_id"] for r in rows)


def test_null_and_repeated_rows(spark):
    from skein.llm import simhash

    say = lambda seed, n=400: " ".join(random.Random(seed).choices("one two three four five six seven eight nine ten".split(), k=n))
    near = [" ".join([*say(1).split()[:-1], x]) for x in ("end", "last", "stop")]
    long = say(3, 400_000)  # more than one block of bytes
    docs = [(4, say(1)), (2, say(1)), (9, near[0]), (8, near[1]), (7, near[2]), (None, say(1)), (None, None), (5, None), (5, "x"), (5, "x"), (6, ""), (6, "two WORDS"), (3, "Two words"), (11, " \n"), (12, long), (13, long + " more")]
    table = spark.createDataFrame([(k, t, 1, "clash") for k, t in docs], "doc_id long, text string, fingerprint int, component string")
    assert sorted(map(tuple, simhash.link_documents(table).collect()), key=repr) == expected(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_close_fingerprints(spark, seed):
    """Clusters, chains and balls of fingerprints, in which most links are of two or three bits."""
    from skein.llm import simhash

    rnd = random.Random(seed)
    flip = lambda x, n: x ^ sum(1 << b for b in rnd.sample(range(64), n))
    prints = [0, (1 << 64) - 1]
    for _ in range(60):
        x = rnd.getrandbits(64)
        prints += [x, *(flip(x, rnd.randint(1, 4)) for _ in range(rnd.randint(0, 8)))]
        for _ in range(rnd.randint(0, 6)):
            x = flip(x, 3)
            prints.append(x)
    prints += [prints[5]] * 3
    signed = [(int(np.uint64(x).view(np.int64)),) for x in prints]
    found = {r["node"]: r["root"] for r in simhash.near_fingerprints(spark.createDataFrame([*signed, (None,)], "fingerprint long")).collect()}
    groups: dict = {}
    for x, r in components(prints).items():
        groups.setdefault(r, set()).add(int(np.uint64(x).view(np.int64)))
    assert found == {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


def test_mixing_is_undone():
    from skein.llm import common, simhash

    x = np.random.default_rng(3).integers(0, 1 << 64, 1000, dtype=np.uint64)
    assert (simhash._unmixed(common.mix(x)) == x).all()
