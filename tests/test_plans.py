"""Plan shape of every registered query: no cartesian or nested-loop joins, and
per-group top-n planned as a window group limit (partial top-n before the shuffle)."""

import pytest

import __spark_entry__ as entry
from churnlens.plans import catalog
from conftest import SF_SMALL

# the two whole-training queries are covered by test_invariants (job and tuning tests)
NAMES = sorted(set(catalog.QUERIES) - {"training_importance", "tune_trials"})
GROUP_LIMITED = ["sample_per_band", "similar_customers", "head_sample"]
PER_CUSTOMER = ["linear_shap", "top_factors", "factor_bars", "waterfall"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", GROUP_LIMITED)
def test_top_n_is_group_limited(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan or "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("name", PER_CUSTOMER)
def test_attribution_rows_need_no_shuffle(spark, name):
    assert "Exchange" not in _plan(entry.queries()[name](spark, SF_SMALL))


def test_flagship_prunes_columns(spark):
    plan = _plan(entry.queries()["risk_kpis_by_contract"](spark, SF_SMALL))
    assert "ReadSchema: struct<tenure:int,Contract:string,MonthlyCharges:double>" in plan


def test_filters_reach_the_scan(spark):
    plan = _plan(entry.queries()["apply_filters"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(tenure), IsNotNull(MonthlyCharges), In(Contract" in plan
