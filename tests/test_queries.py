"""Queries against DuckDB running their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from tessera import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def shown(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, sf_dir, con, name):
    df, rel = catalog.QUERIES[name](spark, sf_dir), con.sql(catalog.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(shown(r[c]) for c in cols) for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
