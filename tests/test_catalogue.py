"""Every registered query against its SQL twin."""

import os

import duckdb
import pytest

import __spark_entry__ as driver

QUERIES = driver.queries()
ORACLES = driver.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    folder = driver.SMOKE_DIR
    for name in os.listdir(folder):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return connection


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, folder, name):
    frame = QUERIES[name](spark, folder)
    rows = frame.collect()
    assert rows
    if name in ORACLES:
        cursor = database.execute(ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(frame.columns)
        assert ordered(rows, frame.columns) == ordered(cursor.fetchall(), columns)


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows
