"""Every query with a DuckDB text gives the same rows as it, on the smallest tables."""

import os

import duckdb
import pytest

from bytelode.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(DATA):
        connection.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return connection


def plain(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) and value == value:
        return f"{float(value):.9g}"
    return "" if value is None or value != value else str(value)


def rows(frame):
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, duck, name):
    mine, other = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
