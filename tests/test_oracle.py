"""Every query of the engine that has SQL gives the same rows in DuckDB; the others give rows."""

import pytest
from compare import assert_same, connect

from voxlake.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, small, name):
    assert_same(QUERIES[name](spark, small), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() >= 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
