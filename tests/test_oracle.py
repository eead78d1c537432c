"""Every registered query against its SQL twin in DuckDB, on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracle import canonical
from transitloom.sources.bindings import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_matches_oracle(spark, db, name):
    df = entry_points.queries()[name](spark, FOLDER)
    rows = [tuple(row) for row in df.collect()]
    result = db.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, rows) == canonical(columns, result.fetchall())


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() >= 0
