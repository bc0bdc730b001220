"""Every query with SQL gives the SQL's rows, as DuckDB computes them."""

import os

import duckdb
import pytest

from barloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v != v:
        return "null"
    return f"{float(v):.4f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    found = duck.sql(plans.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    place = [found.columns.index(c) for c in columns]
    want = sorted(tuple(_plain(r[i]) for i in place) for r in found.fetchall())
    assert sorted(tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == want


def test_other_queries_run(spark, sf):
    for name in set(plans.QUERIES) - set(plans.ORACLE) - {"nsga2_weights"}:
        assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
