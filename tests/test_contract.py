"""The registered queries against the same questions in SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from timeloom.plans import workload, workload_sql

SF_DIR = Path("/root/testdata/sf0.001")
TABLES = ["customer", "orders", "lineitem", "events", "documents", "conversations"]
QUERIES = workload.queries()
SQL = contract.oracle_sql()

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def test_names():
    assert set(workload_sql.oracle_sql()) == set(QUERIES)
    assert set(SQL) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["line", "timestamp", "click", "error", "purchase", "signup", "view"]
    assert df.count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, str(SF_DIR))
    result = db.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, result.fetchall())
