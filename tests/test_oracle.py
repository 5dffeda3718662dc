"""Every registered query against its DuckDB statement on sf0.001 (the
driver does the same at sf0.01): same columns, same rows, doubles exact."""

import math

import duckdb
import pytest
from conftest import SF_SMALL

import __spark_entry__ as entry
from ledgerlens.plans.catalog import QUERIES
from oracle_sql import SQL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("null",)
    if isinstance(v, float):
        return ("f", repr(v))
    if hasattr(v, "isoformat"):
        return ("t", v.isoformat())
    return (type(v).__name__, v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_is_registered_with_oracle_or_listed():
    rows_only = {"categorize_ml", "knn_lsh"}
    assert set(QUERIES) - set(SQL) == rows_only
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    rows = df.collect()
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    a = sorted(tuple(norm(r[c]) for c in sorted(cols)) for r in rows)
    oi = {c: i for i, c in enumerate(ocols)}
    b = sorted(tuple(norm(r[oi[c]]) for c in sorted(cols)) for r in orows)
    assert a == b


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
