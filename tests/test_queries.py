"""Every registered query of the engine against DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

from shroudlake import registered

from .against import SF, assert_same, database


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(spark, con, name):
    out = registered.QUERIES[name](spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name in registered.SQL:
        assert_same(out, registered.SQL[name], con)
    else:
        assert out.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())
