"""Queries with SQL against that SQL, on small tables."""

import os

import pytest

import harness
from pulseline.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = harness.connect(FOLDER)
    assert con.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0] > 0
    assert harness.compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == []
