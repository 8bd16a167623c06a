"""Every registered query against DuckDB on the smallest data folder."""

import os

import pytest

import suite.all  # noqa: F401
from suite.compare import connect, difference
from suite.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert difference(df, duck, ORACLES[name]) is None
    else:
        assert df.count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as entry_point

    assert entry_point.entry(spark).count() == 5
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
