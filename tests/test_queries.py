"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools import check

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    return connection


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, small, name):
    _, verdict = check.compare(spark, con, name, small, SQL.get(name))
    assert verdict.startswith(("ok", "rows")), verdict
