"""The filter audit against brute force: every order applied document by document."""

from __future__ import annotations

import itertools
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")


def failures(docs: list[tuple]) -> list[set]:
    least: dict[str, int] = {}
    for k, _, t in docs:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    out = []
    for k, _, text in docs:
        t, words = text or "", WORD.findall(text or "")
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and least[t] < k}
        out.append({f for f, yes in fails.items() if yes})
    return out


def brute(docs: list[tuple], labels: list[tuple]) -> dict:
    good, toxic = ({k for k, *v in labels if v[i] == 1} for i in (0, 1))
    fails, out = failures(docs), {}
    shapley: dict = defaultdict(int)
    for order in map("".join, itertools.permutations("ABCDE")):
        left = list(range(len(docs)))
        for step, f in enumerate(order, 1):
            lost = [i for i in left if f in fails[i]]
            left = [i for i in left if f not in fails[i]]
            for part in {p or "" for _, p, _ in docs}:
                mine = lambda rows: [i for i in rows if (docs[i][1] or "") == part]  # noqa: E731, B023
                own, all_ = mine(lost), mine(range(len(docs)))
                shapley[part, f] += len(own)
                out[part, order, step] = [len(mine(left)), len(own), sum(f in fails[i] for i in all_) - len(own), sum(fails[i] == {f} for i in all_), sum(docs[i][0] in good for i in own), sum(docs[i][0] in toxic for i in own)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def rows_of(df) -> dict:
    return {tuple(r[:3]): tuple(r[3:]) for r in df.collect()}


def small() -> list[tuple]:
    long = " ".join(f"w{i}" for i in range(220))
    texts = [None, "", "", long, long, long + " #", "Shout " * 210, long + " X", "a b c", "a b c", long.upper(), "# " * 300]
    docs = [(i, ("s", "t", None)[i % 3], t) for i, t in enumerate(texts)]
    return [*docs, (None, "s", long), (None, "s", long), (3, "s", long), (3, "t", "other text"), (2, "t", "a b c")]


def test_against_brute_force(spark):
    from skein.llm import filter_audit

    labels = [(i, i % 2, (i // 2) % 2) for i in range(9)] + [(3, 0, 1), (None, 1, 1), (4, None, None)]
    docs = small()
    table = spark.createDataFrame([(*d, "clash", "clash") for d in docs], "doc_id long, source string, text string, part string, mask string")
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, text string")
    found = filter_audit.audit(filter_audit.masks(table, marks))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = rows_of(found)
    assert len(rows) == 3 * 600 and rows == brute(docs, [x for x in labels if x[0] is not None])


def test_query(spark, odd, tables):
    from skein.llm.queries import queries

    d, x = tables["documents"].to_pydict(), tables["labels"].to_pydict()
    docs = list(zip(d["doc_id"], d["source"], d["text"], strict=True))
    rows = rows_of(queries()["op11_filter_audit"](spark, odd))
    assert rows == brute(docs, [r for r in zip(x["doc_id"], x["quality"], x["toxic"], strict=True) if r[0] is not None])


@pytest.mark.parametrize("where", ["odd", "empty"])
def test_sql(spark, request, where):
    from skein.llm.queries import oracle_sql, queries

    path = request.getfixturevalue(where)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    found = queries()["op11_filter_audit"](spark, path)
    got = con.execute(oracle_sql()["op11_filter_audit"])
    assert [c[0] for c in got.description] == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(got.fetchall())


@pytest.mark.parametrize("k", [1, 3, 5])
def test_survivors(k):
    from skein.llm import filter_audit

    counts = np.random.default_rng(k).integers(0, 50, (4, 1 << k, 3))
    left = filter_audit.survivors(counts)
    for s in range(1 << k):
        assert (left[:, s] == sum(counts[:, m] for m in range(1 << k) if m & s == 0)).all()
