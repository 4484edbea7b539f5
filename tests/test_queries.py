"""Every query against its SQL in DuckDB, on a small scale."""

from __future__ import annotations

import math

import duckdb
import fixture_queries
import pytest

from skein.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations labels pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 9) if isinstance(x, float) and math.isfinite(x) else x


def agree(duck, df, sql: str) -> None:
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    got = duck.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(df.columns) == sorted(names)
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
    assert rows


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    if name in registry.oracle_sql():
        agree(duck, df, registry.oracle_sql()[name])
    else:
        assert df.count()


@pytest.mark.parametrize("name", sorted(fixture_queries.QUERIES))
def test_fixtures_against_sql(spark, duck, name):
    agree(duck, fixture_queries.QUERIES[name](spark, ""), fixture_queries.SQL[name])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_every_query_reads_a_table(spark, name):
    """None can do without the given folder."""
    with pytest.raises(Exception, match="absent"):
        registry.queries()[name](spark, "/absent").collect()
