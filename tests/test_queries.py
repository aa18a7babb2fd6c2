"""Every query against the SQL that must agree with it, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from cardmill.plans import all_queries

SF_DIR = Path("/root/testdata/sf0.001")
ORACLES = entry_point.oracle_sql()
#: The operators' queries that SQL can't express are tested beside their operators.
QUERIES = {name: query for name, query in entry_point.queries().items() if name in ORACLES}

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in sorted(SF_DIR.glob("*.parquet")):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(all_queries()) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    frame = QUERIES[name](spark, str(SF_DIR))
    columns = sorted(frame.columns)
    found = [tuple(row[c] for c in columns) for row in frame.collect()]
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    wanted = [tuple(row[i] for i in places) for row in relation.fetchall()]
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
