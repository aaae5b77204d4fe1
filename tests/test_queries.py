"""Every registered query against its SQL, and what the plans must not contain."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, rows_of
from siftdesk.plans import oracle, queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = queries.registered(), oracle.statements()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    mine = rows_of(df.toPandas())
    theirs = rows_of(duck.execute(ORACLE[name]).df())
    assert mine == theirs
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert word not in plan


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries())


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert [r.field for r in rows] == ["category", "severity", "suggested_response"]
