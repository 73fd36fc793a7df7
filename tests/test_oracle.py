"""Every query with a SQL twin agrees with it on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    err = compare(entry.queries()[name](spark, sf), con, ORACLES[name])
    assert err is None, err


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "parent_child_rarity" in df.columns


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(entry.queries())
