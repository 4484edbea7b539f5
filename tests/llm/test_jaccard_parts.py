"""Rules of the Jaccard join that the query over the odd tables does not show."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from brute import link_rows


def test_one_id_on_two_texts(spark):
    """Each text of an id links by its own set, whatever other text has the id."""
    from skein.llm import jaccard

    say = lambda name, n: " ".join(f"{name}w{k}" for k in range(n))
    rows, expected = [], Counter()
    for i in range(12):
        short, long = say(f"s{i}", 60), say(f"l{i}", 1500)
        rows += [(i, short), (i, long), (100 + i, short + " more"), (200 + i, long + " more"), (300 + i, say(f"o{i}", 60))]
        for key, n, component in ((i, 56, i), (i, 1496, i), (100 + i, 57, i), (200 + i, 1497, i), (300 + i, 56, 300 + i)):
            expected[key, n, component] += 1
    found = jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert Counter(tuple(r) for r in found) == expected


def token_rows(token: np.ndarray, salt: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    n = node % 90 + 1
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(salt.astype(np.int32)), pa.array(node), pa.array(n << 32 | node)], ["token", "salt", "high", "low"])


def rows_of(batches) -> tuple[set, list]:
    tiles, edges = set(), []
    for batch in batches:
        for tile, node, n, other in zip(*(batch.column(c).to_pylist() for c in ("tile", "node", "n", "other")), strict=True):
            if other is None:
                tiles.add((tile, node, n))
            else:
                edges.append((node, other))
    return tiles, edges


def test_tiles_leave_as_tokens_end():
    """Tiles of ended tokens go out while rows still come, a large token's rows stay together, and all tiles are those of
    one batch."""
    from skein.llm import jaccard

    rnd = np.random.default_rng(5)
    token = np.sort(np.concatenate([rnd.integers(-(1 << 60), 1 << 60, 150_000).repeat(2), np.full(200_000, 7)]))
    rows = token_rows(token, np.zeros(len(token)), rnd.integers(0, 50_000, len(token)))
    read = 0

    def batches():
        nonlocal read
        for at in range(0, len(token), 10_000):
            read += 1
            yield rows.slice(at, 10_000)

    early, found = 0, []
    for batch in jaccard._tiles(batches()):
        early += read < len(token) // 10_000
        found.append(batch)
    tiles, edges = rows_of(found)
    whole, one = rows_of(jaccard._tiles(iter([rows])))
    assert early and tiles == whole and len({a for a, _ in edges} | {b for _, b in edges}) == len({a for a, _ in one} | {b for _, b in one}) > 2000


def test_dealt_tokens_stay_connected():
    """A token whose rows are dealt over tasks, or that is too large for a tile, connects its sets through a node of its own."""
    from skein.llm import jaccard

    node = np.arange(1, 40)
    parts = [rows_of(jaccard._tiles(iter([token_rows(np.full(len(some), 5), np.full(len(some), k), some)]))) for k, some in ((1, node[:20]), (2, node[20:]))]
    assert not parts[0][0] and not parts[1][0]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, edges in parts:
        for a, b in edges:
            parent[find(a)] = find(b)
    assert len({find(x) for x in list(parent)}) == 1 and len(parent) == 40


def test_hot_shingles_are_dealt():
    """By the sketch, the prefix shingles of frequent counters get salts, others none."""
    from types import SimpleNamespace

    from skein.llm import jaccard
    from skein.llm.common import blocks

    texts = [" ".join(f"w{i}" for i in range(40)) + f" own{k}" for k in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    counts = np.zeros(1 << jaccard.SKETCH_BITS, np.int32)
    cold = pa.Table.from_batches(jaccard._prefixes(SimpleNamespace(value=counts))(iter([batch])))
    assert set(cold.column("salt").to_pylist()) == {0}
    for _, data, offsets in blocks(iter([batch]), "text"):
        for x in jaccard.shingle_sets(data, offsets):
            counts[jaccard._counter(x)] = 8 * jaccard.HOT
    hot = pa.Table.from_batches(jaccard._prefixes(SimpleNamespace(value=counts))(iter([batch])))
    assert 3 < len(set(hot.column("salt").to_pylist())) <= 9 and 0 not in hot.column("salt").to_pylist()
    assert hot.num_rows == cold.num_rows


def test_bitmaps_never_refuse_a_link():
    from skein.llm import jaccard

    rnd = np.random.default_rng(3)
    for size in (5, 200, 257, 3000):
        base = rnd.integers(0, 1 << 63, size + size // 4).astype(np.uint64)
        sets = [np.unique(base[: size - size // 12]), np.unique(base[:size]), np.unique(base), np.unique(rnd.integers(0, 1 << 63, size).astype(np.uint64))]
        sets.sort(key=len)
        n = np.array([len(x) for x in sets])
        rows = [jaccard.bitmap(x) for x in sets]
        maps = jaccard._Bitmaps(n, np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])]))
        i, j = np.triu_indices(len(sets), 1)
        linked = np.array([jaccard.links(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b]))) for a, b in zip(i, j, strict=True)])
        allowed = maps.may_link(i, j)
        assert linked.any() and not (linked & ~allowed).any() and not allowed.all()


def test_groups_in_bands(spark, monkeypatch):
    """Large groups in bands of a few sets: near copies that the chain of bands joins, texts with common parts, and a group
    that stays open, where sets outside the largest part must still find it."""
    from skein.llm import jaccard

    words = [f"w{i}" for i in range(60)]
    own = {i: " ".join([*words[: i % 30], f"v{i}", *words[i % 30 :]]) for i in range(40)}
    own |= {100 + i: " ".join(f"u{k}" for k in range(i * 2, i * 2 + 40)) for i in range(20)}
    own |= {200 + i: " ".join([*(f"t{k}" for k in range(30)), *(f"x{i}y{k}" for k in range(9))]) for i in range(20)}
    own |= {300 + i: " ".join(f"z{k}" for k in range(i, 60 + 2 * i)) for i in range(30)}
    monkeypatch.setattr(jaccard, "BAND", 4)
    rows = jaccard.link_documents(spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {k: r["component_id"] for k, r in link_rows(own).items()}


def test_repeated_rows_and_null_ids(spark):
    from skein.llm import jaccard

    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(1, a), (1, a), (2, a + " x"), (None, a), (None, b), (3, None), (3, None), (4, b)]
    found = jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in found) == Counter([(1, 46, 1), (1, 46, 1), (2, 47, 1), (None, 46, None), (None, 46, None), (3, 0, 3), (3, 0, 3), (4, 46, 4)])


def test_components(spark):
    from skein.llm.components import components

    edges = [(1, 2), (2, 3), (9, 8), (8, 9), (5, 5), (None, 4), (3, 1), *((k, k + 1) for k in range(100, 140))]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {k: 100 for k in range(100, 141)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
