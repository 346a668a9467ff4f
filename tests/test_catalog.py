"""Registered queries against DuckDB on the smallest data set."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and out.columns[0] == "o_orderstatus"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
