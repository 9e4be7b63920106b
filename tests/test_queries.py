"""Every query against its SQL on the smallest tables, and the shape of the plans."""

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from tallyfold.plans.catalog import QUERIES
from tallyfold.plans.expected import SQL
from tests.compare import compare, duck

FITTED = {"ml_scores", "text_ml_scores", "tabular_ml_scores", "stack_fusion"}


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE_DIR)


def test_names():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, SMOKE_DIR), con, SQL[name]) is None


CHEAP_TO_PLAN = sorted(set(QUERIES) - FITTED - {"model_reload_same_scores"})


@pytest.mark.parametrize("name", CHEAP_TO_PLAN)
def test_plan_has_no_cross_join(spark, name):
    plan = queries()[name](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_flagship_scans_once_and_prunes(spark):
    df = entry(spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final
