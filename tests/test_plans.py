"""Physical-plan guards: what the optimizer must do for every registered query."""

import pytest

from assayflow.operators import joins, lod, multiple, ols, quantile
from assayflow.plans import catalog
from tests.conftest import SF001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")
PYTHON = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


@pytest.fixture
def whole_plans(monkeypatch):
    """Written tables stay part of the plan that reads them."""
    for module in (joins, lod, multiple, ols, quantile):
        monkeypatch.setattr(module, "written", lambda df, name="": df)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins_and_no_python_in_registered_queries(spark):
    offenders = {}
    for name, fn in catalog.queries_map().items():
        plan = _plan(fn(spark, SF001))
        bad = [op for op in FORBIDDEN + PYTHON if op in plan]
        if bad:
            offenders[name] = bad
    assert not offenders, offenders


def test_scan_pruning_and_pushdown(spark, whole_plans):
    import re
    qs = catalog.queries_map()
    plan = _plan(qs["ols_sweep"](spark, SF001))
    # lineitem is read with the five columns the regression needs, not all eleven
    cols = re.search(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem\.parquet", plan).group(1)
    assert sorted(c.split("#")[0] for c in cols.split(",")) == sorted(
        ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"])
    # the time-point filter is evaluated at the orders scan, below every join
    assert re.search(r"DataFilters: \[[^\n]*year[^\n]*orders\.parquet", plan)
    plan = _plan(qs["dedup_rows"](spark, SF001))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan


def test_chained_steps_keep_plans_linear(spark):
    qs = catalog.queries_map()
    for name in ("preprocess_steps", "lod_correct_replace"):
        plan = _plan(qs[name](spark, SF001))
        assert plan.count("Exchange") < 40, name


def test_per_feature_statistics_aggregate_before_the_shuffle(spark, whole_plans):
    """A feature holding a third of all rows is reduced map-side: every
    statistics aggregation runs a partial step before its exchange."""
    qs = catalog.queries_map()
    expect = {"welch_by_feature": ("partial_avg", "partial_var_samp"),
              "ols_sweep": ("partial_regr_sxy",),
              "standardize": ("partial_avg", "partial_stddev_pop"),
              "fold_change_groups": ("partial_percentile_approx", "partial_count")}
    for name, parts in expect.items():
        plan = _plan(qs[name](spark, SF001))
        for p in parts:
            assert p in plan, (name, p)
