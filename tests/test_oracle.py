"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry

# The training-data queries have tests of their own.
QUERIES = [q for q in entry.queries() if not re.match(r"op\d+_|pipeline$", q)]
SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_matches_oracle(spark, duck, name):
    result = entry.queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    rows = sorted(repr(tuple(row[c] for c in columns)) for row in result.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(row[i] for i in places)) for row in cursor.fetchall())
    assert rows == expected


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
