"""Every registered query against its SQL on the smallest tables."""

import pytest

from paneloom.plans import ORACLES, QUERIES
from tests.oracle import compare, duckdb_connection


@pytest.fixture(scope="module")
def con(folder):
    return duckdb_connection(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, folder, con, name):
    assert compare(QUERIES[name](spark, folder), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert len(df.columns) > 0 and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
