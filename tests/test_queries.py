import importlib.util

import pytest
from compare import differences, duck

from tidewell.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), SQL[name], con) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("entry", __file__.replace("tests/test_queries.py", "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_interval_join_is_planned_on_equality(spark):
    plan = QUERIES["window_counts_closed"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bootstrap_query_makes_the_references_draws(spark):
    from tidewell.operators import stats
    from tidewell.plans.queries import _paired, rounded

    draws = lambda n: rounded(stats.bootstrap_median(_paired(spark, SF), "diff", n), {"lo": 4, "hi": 4}).first()
    assert QUERIES["bootstrap_ci"](spark, SF).first() == draws(20000) != draws(500)
