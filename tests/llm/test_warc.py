"""Archives whose records reach over many ranges, broken chains and wrong digests."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

HEAD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nWARC-Payload-Digest: sha1:{}\r\nContent-Length: {}\r\n\r\n"


def record(page: int, payload: bytes) -> bytes:
    return HEAD.format(page, hashlib.sha1(payload).hexdigest(), len(payload)).encode() + payload + b"\r\n\r\n"


def payloads() -> list[bytes]:
    inner = record(900, b"not a record of the file")
    odd = [b"", b"plain", inner, inner * 40, b"WARC/1.1\r\n" * 300, inner[:-1], b"x" * 5000, b"\r\n\r\nWARC/1.1\r\nContent-Length: 7\r\n\r\n" * 50, "é\u0000".encode() * 900]
    return [odd[i % len(odd)] + str(i).encode() * (i % 3) for i in range(120)]


@pytest.fixture
def in_ranges(spark):
    """Files are read in ranges of 4 KB."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_records_over_ranges(spark, tmp_path, in_ranges):
    from skein.llm import warc

    every = payloads()
    for name, some in (("a.warc", range(0, 60)), ("b.warc", range(60, 120)), ("none.warc", range(0))):
        (tmp_path / name).write_bytes(b"".join(record(i, every[i]) for i in some))
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert Counter(map(tuple, rows)) == Counter((i, len(p), hashlib.sha1(p).hexdigest(), "response", None) for i, p in enumerate(every))


def test_second_read_in_other_ranges(spark, tmp_path, in_ranges):
    """Executors come and go between the two reads, and Spark deals the files out anew."""
    from skein.llm import warc

    every = payloads()
    (tmp_path / "a.warc").write_bytes(b"".join(record(i, p) for i, p in enumerate(every)))
    found = warc.read_warc(spark, f"file://{tmp_path}")
    for size in (1500, 40_000, 1 << 27):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = found.select("*", F.lit(size)).collect()
        assert Counter(r[:5] for r in rows) == Counter((i, len(p), hashlib.sha1(p).hexdigest(), "response", None) for i, p in enumerate(every))


def test_broken_archives_raise(spark, tmp_path, in_ranges):
    from skein.llm import warc

    whole = b"".join(record(i, p) for i, p in enumerate(payloads()[:30]))
    for name, raw in (("cut", whole[:-3]), ("long", whole + b"more"), ("late", b"junk" + whole), ("gap", record(1, b"a") + b"junk" + record(2, b"b"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(raw)
        with pytest.raises(ValueError, match="chain of records"):
            warc.read_warc(spark, f"file://{tmp_path}/{name}").collect()
    (tmp_path / "digest").mkdir()
    (tmp_path / "digest" / "x.warc").write_bytes(record(1, b"abc") + record(2, b"right").replace(b"right", b"wrong"))
    with pytest.raises(Exception, match="digest in its header"):
        warc.read_warc(spark, f"file://{tmp_path}/digest").collect()


def test_null_keys_and_repeated_rows(spark, tmp_path):
    from skein.llm import warc

    big = "p" * 2000
    rows = [(1, "http://a/", big), (2, "http://b/", big), (None, "http://c/", big), (None, None, None), (3, "http://d/", "s"), (3, "http://d/", "s"), (2, "http://b/", big)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w")
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    expected = [(1, 2000, sha(big), "revisit", 2), *[(2, 2000, sha(big), "response", None)] * 2, (None, 2000, sha(big), "response", None), (None, 0, sha(""), "response", None), *[(3, 1, sha("s"), "response", None)] * 2]
    assert Counter(map(tuple, warc.read_warc(spark, f"{tmp_path}/w").collect())) == Counter(expected)


def test_jumped():
    from skein.llm import warc

    at = np.array([10, 20, 35, 50, 70])
    step, last = warc.jumped(at, np.array([35, 21, 50, 99, 10]))
    assert step.tolist() == [2, 1, 3, 3, 0] and last.tolist() == [3, 1, 3, 3, 3]
