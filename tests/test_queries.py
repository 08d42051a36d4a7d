"""Every query of the catalog against its checking SQL at the smallest scale."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry_point
from tracelight.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_statement_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(QUERIES) <= set(entry_point.queries())
