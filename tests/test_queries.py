"""Every registered query of the engine against its SQL, and the rest for running at all."""

import pytest

from tapeworks import plans
from tests.compare import assert_same

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).toPandas() is not None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_one_shuffle_serves_a_sessions_windows(spark, sf_dir):
    """The flagship sorts and shuffles once for all its windows."""
    plan = QUERIES["WIN06_rolling_vwap"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
