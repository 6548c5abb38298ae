"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexiloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    result = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = sorted(repr([plain(dict(zip(columns, row))[c]) for c in sorted(columns)]) for row in result.fetchall())
    ours = sorted(repr([plain(row[c]) for c in sorted(columns)]) for row in df.collect())
    assert ours == theirs


def test_entry_has_rows_and_queries_exist(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["lr_fit_predict", "permutation_importance", "stm_topics", "lda_topics"])
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0
