"""Every query against its DuckDB SQL, and the rest for rows and a stable schema."""

from __future__ import annotations

import duckdb
import pytest

from millrace import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return "" if v is None else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    df = Q.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    o = duck.sql(Q.oracle_sql()[name])
    at = [o.columns.index(c) for c in cols]
    assert sorted(o.columns) == cols
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in o.fetchall())


@pytest.mark.parametrize("name", [n for n in Q.queries() if n not in Q.oracle_sql()])
def test_has_rows(spark, sf, name):
    assert Q.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
