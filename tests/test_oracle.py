"""Every query with an SQL meaning, compared value by value with DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from harness import compare, connect

FOLDER = f"/root/testdata/sf{os.environ.get('PULSE_SF', '0.001')}"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) == []


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"route_id", "reliability_score", "reliability_band"} <= set(df.columns)


def test_every_statement_gives_rows_at_the_compared_scale():
    """An empty result on both sides would prove nothing."""
    larger = connect("/root/testdata/sf0.01")
    empty = [n for n, sql in entry.oracle_sql().items() if larger.execute(f"SELECT 1 FROM ({sql}) LIMIT 1").fetchone() is None]
    assert empty == []
