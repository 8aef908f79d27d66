"""Every core query runs; those with SQL say the same as DuckDB."""

import math

import duckdb
import pytest

from placelens.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Long iterative queries; their operators have tests of their own.
SLOW = {"v1_train_tree", "v19_build_vocabulary", "g1_euclidean_clusters"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    return str(v)


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = df.collect()
    assert got
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_entry_imports_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
