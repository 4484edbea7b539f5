"""Folders of small tables: 'odd' has rows of sf0.001 and every awkward case, 'empty' has no rows."""

from __future__ import annotations

import functools
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SMALL = "/root/testdata/sf0.001"


def morse(n: int) -> str:
    """The Thue-Morse word of a and b: sums of powers modulo 2^64 don't tell it from its complement."""
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def other(text: str) -> str:
    return text.translate(str.maketrans("ab", "ba"))


def odd_texts() -> list[str | None]:
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage = say(80)
    base = say(120).split()
    near = [*base]
    near[3] = "changed"
    twins = [" ".join(base), " ".join(near), " ".join([*near[:-1], "other"])]
    return [
        None, "", " ", "\n\t \u00a0", "one", "One two", "one two three four", "\x1c\x1f a\x1cb \x85 c", "ÄÖÜ ß İı ﬁ Ⅷ \u2003 x", "🎉🎉 👩‍👩‍👧 e\u0301", "\ufffd\u0000nul",
        morse(1024), other(morse(1024)), morse(2048), other(morse(2048)), "x " + morse(1024) + " y", "x " + other(morse(1024)) + " y",
        say(30) + " " + passage + " " + say(30), passage, passage + passage, say(10) + passage[:150], "a" * 5000, "ab" * 3000 + " " + "ab" * 3000, "the of and " * 400,
        *twins, twins[0], twins[0].upper(), say(30000), "x y\n" * 3000, "  lead and trail  ", "don't we'll I'M\r\n\r\n1234567 $$%&|<> ...", "<|endoftext|> <|startoftext|> </w>", *[say(70)] * 3,
    ]


def odd_tables() -> dict[str, pa.Table]:
    documents = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    texts = odd_texts()
    start = max(documents["doc_id"]) + 1
    rows = {
        "doc_id": documents["doc_id"] + list(range(start, start + len(texts))),
        "text": documents["text"] + texts,
        "lang": documents["lang"] + [("en", None, "xx", "de")[i % 4] for i in range(len(texts))],
        "source": documents["source"] + [None] * len(texts),
        "n_chars": documents["n_chars"] + [None] * len(texts),
    }
    for name in ("score", "kept", "th", "h", "n_words", "node", "rest"):  # columns that clash with results or inner names
        rows[name] = ["clash"] * len(rows["doc_id"])
    items = pq.read_table(f"{SMALL}/benchmark.parquet").to_pydict()
    words = (documents["text"][1] or "").split()
    more = [None, "", "one two", "Zebra", " ".join(words[3:25]), " ".join(words[5:15]), texts[12], texts[12], "a b c d e f g h i j k l"]
    first = max(items["item_id"]) + 1
    benchmark = {"item_id": items["item_id"] + [*range(first, first + len(more) - 1), None], "text": items["text"] + more}
    pages = pq.read_table(f"{SMALL}/pages.parquet").to_pydict()
    big = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40
    n = max(pages["page_id"]) + 1
    more_pages = [
        (None, None), ("", ""), ("no scheme", big), ("HTTP://Example.COM/en/x", big), ("http://www.example.com/en/?q", big), ("http://a.net/es/", "x" * 999), ("http://a.net/es/", "x" * 999), ("http://anet/fr/", "é" * 500), ("http://b.NET/fr/1#z", "é" * 500),
        ("http://com/", "\r\n\r\n"), ("http://wwwexample.com/en/", "\n"), ("a://b://c.com/d", None), ("http://x.com?y=/z", "WARC/1.1\r\n"), ("http://exe.org/a.exe", "q"), ("http://u.net/" + "a/" * 4000, "q"), ("http://ü.com/ß", "\u0000"), ("http://net/es", "r"),
    ]
    table = {"page_id": pages["page_id"] + [*range(n, n + len(more_pages))], "url": pages["url"] + [a for a, _ in more_pages], "html": pages["html"] + [b for _, b in more_pages]}
    labels = pq.read_table(f"{SMALL}/labels.parquet").to_pydict()
    labels = {"doc_id": labels["doc_id"] + [None, start, 10**9], "quality": labels["quality"] + [1, None, 1], "toxic": labels["toxic"] + [0, 1, None]}
    types = {"doc_id": pa.int64(), "n_chars": pa.int64(), "item_id": pa.int64(), "page_id": pa.int64(), "quality": pa.int32(), "toxic": pa.int32()}
    make = lambda d: pa.table({k: pa.array(v, types.get(k, pa.string())) for k, v in d.items()})
    return {"documents": make(rows), "benchmark": make(benchmark), "pages": make(table), "labels": make(labels)}


@pytest.fixture(scope="session")
def tables() -> dict[str, pa.Table]:
    return odd_tables()


@pytest.fixture(scope="session")
def odd(tables, tmp_path_factory) -> str:
    path = tmp_path_factory.mktemp("odd")
    for name, table in tables.items():
        pq.write_table(table, path / f"{name}.parquet", row_group_size=50)
    return str(path)


@pytest.fixture(scope="session")
def empty(tables, tmp_path_factory) -> str:
    path = tmp_path_factory.mktemp("empty")
    for name, table in tables.items():
        pq.write_table(table.slice(0, 0), path / f"{name}.parquet")
    return str(path)


@pytest.fixture(scope="session")
def texts(tables) -> dict[int, str]:
    return {k: t or "" for k, t in zip(tables["documents"]["doc_id"].to_pylist(), tables["documents"]["text"].to_pylist(), strict=True)}


@pytest.fixture(scope="session")
def ask(spark, odd):
    """The rows of a query over the odd tables, by their id."""
    from skein.llm.queries import queries

    @functools.cache
    def run(name: str, key: str = "doc_id", path: str = odd) -> dict:
        rows = [r.asDict() for r in queries()[name](spark, path).collect()]
        assert len({r[key] for r in rows}) == len(rows)
        return {r[key]: r for r in rows}

    return run
