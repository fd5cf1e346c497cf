"""Every registered query against its SQL, run by DuckDB on the same files."""

from __future__ import annotations

import collections
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from apptledger.plans.catalog import QUERIES
from oracle.queries import all_sql

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
SQL = all_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    described = {d[0]: str(d[1]) for d in cursor.description}
    order = [d[0] for d in cursor.description]
    assert {c: TYPES[t] for c, t in df.dtypes} == described
    expected = collections.Counter(
        repr(tuple(row[order.index(c)] for c in columns)) for row in cursor.fetchall())
    got = collections.Counter(repr(tuple(row)) for row in df.select(*columns).collect())
    assert got == expected
    assert got, "a query without rows checks nothing"
