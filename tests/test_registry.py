"""Every registered query against its SQL counterpart on the smallest data set."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
# Only few documents hold table rows or long lines, so these may find nothing at this size.
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    assert got, "a query that returns nothing proves nothing"
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        cursor = db.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert normal(got, df.columns) == normal(cursor.fetchall(), names)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
