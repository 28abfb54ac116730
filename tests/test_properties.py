"""Property tests (hypothesis): results must not depend on partitioning or
row order, and must agree with plain numpy on arbitrary inputs."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from assayflow.operators import multiple, preprocess
from assayflow.operators.joins import join_group_stats
from assayflow.operators.quantile import group_median

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

values = st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float),
                            st.floats(-1e3, 1e3, allow_nan=False)), min_size=1, max_size=40)


@SETTINGS
@given(groups=st.lists(values, min_size=1, max_size=4), parts=st.integers(1, 6))
def test_median_equals_numpy_for_any_partitioning(spark, groups, parts):
    rows = [(f"g{i}", v) for i, g in enumerate(groups) for v in g]
    df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    got = {r.g: r.median for r in group_median(df, ["g"], "v").collect()}
    for i, g in enumerate(groups):
        present = [v for v in g if v is not None]
        if present:
            assert got[f"g{i}"] == pytest.approx(float(np.median(present)), rel=1e-12, abs=1e-12)
        else:
            assert f"g{i}" not in got


def _bh_np(p):
    p = np.asarray(p, float)
    m = len(p)
    order = np.argsort(p, kind="stable")
    q = p[order] * m / np.arange(1, m + 1)
    adj = np.minimum.accumulate(q[::-1])[::-1]
    out = np.empty(m)
    out[order] = np.minimum(adj, 1)
    return out


@SETTINGS
@given(p=st.lists(st.one_of(st.floats(0, 1), st.sampled_from([0.0, 0.05, 1.0])),
                  min_size=1, max_size=60),
       parts=st.integers(1, 5))
def test_bh_matches_numpy_monotone_and_order_free(spark, p, parts):
    df = spark.createDataFrame(list(enumerate(p)), "f int, p_value double").repartition(parts)
    got = multiple.bh_adjust(df).toPandas()
    got = got.sort_values("f")
    np.testing.assert_allclose(got.p_bh.to_numpy(), _bh_np(p), rtol=1e-12, atol=1e-15)
    s = got.sort_values("p_value")
    assert (np.diff(s.p_bh.to_numpy()) >= -1e-15).all() and (s.p_bh <= 1).all()


@SETTINGS
@given(levels=st.lists(st.one_of(st.none(), st.floats(0.1, 100)), min_size=2, max_size=30),
       strategy=st.sampled_from(["min", "zero", "uniform"]))
def test_imputation_keeps_present_values(spark, levels, strategy):
    rows = [(f"s{i}", "f", v) for i, v in enumerate(levels)]
    df = spark.createDataFrame(rows, "sample_id string, metabolite string, level double")
    out = {r.sample_id: r.level for r in preprocess.impute(df, strategy=strategy).collect()}
    present = [v for v in levels if v is not None]
    if not present and strategy != "zero":
        assert out == {}
        return
    for i, v in enumerate(levels):
        if v is not None:
            assert out[f"s{i}"] == v
        elif strategy == "uniform":
            assert min(present) / 10 <= out[f"s{i}"] <= min(present)


def test_statistics_join_back_leaves_the_rows_in_place(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "k string, v double")
    joined = join_group_stats(rows, rows.groupBy("k").count(), ["k"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sorted(tuple(r) for r in joined.collect()) == [("a", 1.0, 2), ("a", 2.0, 2), ("b", 3.0, 1)]


@pytest.mark.parametrize("bracket", [1_000_000, 20])
def test_median_brackets_narrow_to_the_exact_value(spark, bracket):
    rng = np.random.default_rng(3)
    values = {"wide": rng.lognormal(0, 4, 5001), "ties": np.repeat([1.0, 2.0], 1500), "one": np.array([7.0])}
    rows = [(k, float(x)) for k, v in values.items() for x in v]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r.k: r.median for r in group_median(df, ["k"], "v", accuracy=20, largest_bracket=bracket).collect()}
    assert got == {k: float(np.median(v)) for k, v in values.items()}


@pytest.mark.parametrize("bracket", [2, 20])
def test_median_of_ties_infinities_and_constants_ends(spark, bracket):
    inf = float("inf")
    values = {"two": [1.0, 2.0] * 700, "ends": [1.0, 2.0, 3.0, inf] * 30, "inf": [-inf] * 50 + [inf] * 50,
              "same": [4.0] * 900, "counts": [0.0] * 400 + [1.0] * 401 + [2.0] * 99,
              "spread": [10.0 ** i for i in range(-150, 150)] * 3}
    rows = [(k, x) for k, v in values.items() for x in v]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r.k: r.median for r in group_median(df, ["k"], "v", accuracy=20, largest_bracket=bracket).collect()}
    want = {k: float(np.median(v)) for k, v in values.items() if k != "inf"}
    assert {k: got[k] for k in want} == want and np.isnan(got["inf"])
