"""t distribution, t-tests and OLS against hand-computed / numpy values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayflow.functions.tdist import t_critical, t_two_sided_p
from assayflow.operators import ols, ttest
from assayflow.plans import fixtures as fx
from tests.conftest import SF001


def _t_pdf_tail(t, nu, n=200000):
    # P(|T| > t) by numerical integration of the density (independent check).
    xs = np.linspace(abs(t), abs(t) + 200, n)
    c = math.gamma((nu + 1) / 2) / (math.sqrt(nu * math.pi) * math.gamma(nu / 2))
    ys = c * (1 + xs * xs / nu) ** (-(nu + 1) / 2)
    return 2 * np.trapezoid(ys, xs)


def test_t_quantiles_and_tails(spark):
    df = spark.createDataFrame([(1.0,), (10.0,), (1000.0,)], "nu double")
    rows = df.select("nu", t_critical("nu").alias("q")).orderBy("nu").collect()
    assert [round(r.q, 4) for r in rows] == [12.7062, 2.2281, 1.9623]
    p = spark.range(1).select(
        t_two_sided_p(F.lit(2.3), F.lit(7.6)).alias("p"),
        t_two_sided_p(F.lit(0.0), F.lit(5.0)).alias("p0"),
        t_two_sided_p(F.lit(1.0), F.lit(None).cast("double")).alias("pn"),
        t_two_sided_p(F.lit(-2.3), F.lit(7.6)).alias("pneg"),
    ).first()
    assert p.p == pytest.approx(0.05212923959642, abs=1e-12)
    assert p.p0 == 1.0 and p.pn is None and p.pneg == pytest.approx(p.p)
    assert p.p == pytest.approx(_t_pdf_tail(2.3, 7.6), abs=1e-6)


def _welch_np(x, y):
    mx, my, vx, vy = np.mean(x), np.mean(y), np.var(x, ddof=1), np.var(y, ddof=1)
    se = math.sqrt(vx / len(x) + vy / len(y))
    df = (vx / len(x) + vy / len(y)) ** 2 / (
        (vx / len(x)) ** 2 / (len(x) - 1) + (vy / len(y)) ** 2 / (len(y) - 1))
    return mx - my, (mx - my) / se, df


def test_welch_matches_formula_and_degenerate_status(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(1, 1, 12), rng.normal(0, 2, 9)
    rows = [("f", 0, float(v)) for v in x] + [("f", 1, float(v)) for v in y]
    rows += [("one", 0, 1.0), ("one", 1, 2.0), ("one", 1, 3.0)]          # group of 1
    rows += [("const", 0, 5.0), ("const", 0, 5.0), ("const", 1, 5.0), ("const", 1, 5.0)]
    rows += [("single", 0, 1.0), ("single", 0, 2.0)]                       # one group only
    rows += [("three", 0, 1.0), ("three", 0, 2.0), ("three", 1, 1.0), ("three", 1, 3.0),
             ("three", 2, 9.0)]                                            # three levels
    rows += [("f", 0, None)]                                               # missing level dropped
    df = spark.createDataFrame(rows, "metabolite string, Progressive int, level double")
    res = {r.metabolite: r for r in ttest.welch_by_group(df).collect()}
    est, stat, dof = _welch_np(x, y)
    assert res["f"].status == "ok"
    assert res["f"].estimate == pytest.approx(est) and res["f"].statistic == pytest.approx(stat)
    assert res["f"].parameter == pytest.approx(dof)
    assert res["f"].p_value == pytest.approx(_t_pdf_tail(stat, dof), abs=1e-6)
    assert res["one"].status == "not_enough_x" and res["one"].p_value is None
    assert res["const"].status == "constant"
    assert res["single"].status == "need_two_groups"
    assert res["three"].status == "need_two_groups"


def test_paired_zero_fill_absent_not_null(spark):
    rows = [("m", "a1", "Day0", 1.0), ("m", "a1", "Day10", 2.0),
            ("m", "a2", "Day0", 2.0),                                   # Day10 absent -> 0
            ("m", "a3", "Day0", 3.0), ("m", "a3", "Day10", None),       # present null stays null
            ("m", "a4", "Day0", 4.0), ("m", "a4", "Day10", 1.0), ("m", "a4", "Day10", 3.0)]
    df = spark.createDataFrame(rows, "metabolite string, animal string, Visit string, level double")
    wide = ttest.pivot_visits(df, values=("Day0", "Day10"), on_duplicate="avg")
    cells = {r.animal: r for r in wide.collect()}
    assert cells["a2"].Day10 == 0.0 and cells["a3"].Day10 is None and cells["a4"].Day10 == 2.0
    res = ttest.paired_t(wide, timepoints=("Day10",)).first()
    d = np.array([1 - 2, 2 - 0, 4 - 2.0])
    assert res.estimate == pytest.approx(d.mean())
    assert res.statistic == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(3)))
    assert res.parameter == 2
    # antisymmetry: swapping the columns flips the sign
    swapped = wide.select("metabolite", "animal", F.col("Day10").alias("Day0"),
                          F.col("Day0").alias("Day10"))
    r2 = ttest.paired_t(swapped, timepoints=("Day10",)).first()
    assert r2.statistic == pytest.approx(-res.statistic)
    # a4 has two Day10 rows: averaged by default, an error on request
    with pytest.raises(Exception, match="duplicate rows"):
        ttest.pivot_visits(df, values=("Day0", "Day10"), on_duplicate="error").collect()


def _lstsq(X, y):
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    dof = len(y) - X.shape[1]
    cov = resid @ resid / dof * np.linalg.inv(X.T @ X)
    return beta[-1], math.sqrt(cov[-1, -1]), dof


@pytest.mark.parametrize("kind", ["categorical", "numeric", "multi", "multi4"])
def test_ols_matches_lstsq(spark, kind):
    base = fx.assay_long(spark, SF001).withColumnRenamed("metabolite", "feature_label")
    kw = {"categorical": dict(covariate="site"), "numeric": dict(covariate="site_num"),
          "multi": dict(covariate="site", numeric_covariates=["site_num", "x_acctbal"]),
          "multi4": dict(covariate="site", numeric_covariates=["site_num", "x_acctbal",
                                                                "x_discount"])}[kind]
    res = ols.regress_features(base, ["x_quantity"], details=True, **kw).toPandas()
    pdf = base.toPandas()
    pdf = pdf[pdf.x_quantity != 0]
    checked = 0
    for feat, g in pdf.groupby("feature_label"):
        cols = [np.ones(len(g))]
        if kind in ("categorical", "multi", "multi4"):
            import pandas as pd
            cols.append(pd.get_dummies(g["site"], drop_first=True, dtype=float).to_numpy())
        if kind == "numeric":
            cols.append(g["site_num"].to_numpy(float))
        if kind in ("multi", "multi4"):
            cols += [g["site_num"].to_numpy(float), g["x_acctbal"].to_numpy(float)]
        if kind == "multi4":  # four slope terms: the Arrow-batched solver path
            cols.append(g["x_discount"].to_numpy(float))
        cols.append(g["x_quantity"].to_numpy(float))
        X = np.column_stack(cols)
        if len(g) <= X.shape[1] or np.linalg.matrix_rank(X) < X.shape[1]:
            continue
        b, se, dof = _lstsq(X, g["level"].to_numpy(float))
        r = res[res.feature_label == feat].iloc[0]
        assert r.LR_Effect_Size == pytest.approx(b, rel=1e-8, abs=1e-10)
        assert r.std_err == pytest.approx(se, rel=1e-8)
        assert r.df == dof
        checked += 1
    assert checked > 5


def _pinv_fit(X, y):
    """Slope, error and degrees of freedom of the last column; None where it
    is a combination of the others."""
    rank = np.linalg.matrix_rank(X, tol=1e-8)
    if rank == np.linalg.matrix_rank(X[:, :-1], tol=1e-8) or len(y) <= rank:
        return None
    inverse = np.linalg.pinv(X, rcond=1e-10)
    beta = inverse @ y
    resid = y - X @ beta
    dof = len(y) - rank
    return beta[-1], math.sqrt(resid @ resid / dof * (inverse @ inverse.T)[-1, -1]), dof


def _same_fit(row, want):
    if want is None:
        assert row.LR_Effect_Size is None and row.LR_P_Value is None
        return
    assert row.LR_Effect_Size == pytest.approx(want[0], rel=1e-7, abs=1e-10)
    assert row.std_err == pytest.approx(want[1], rel=1e-7)
    assert row.df == want[2]


def test_ols_collinear_covariates_equal_pseudo_inverse(spark):
    rng = np.random.default_rng(5)
    rows = []
    for f in ("twice", "constant", "x_is_covariate", "full", "few"):
        for _ in range(6 if f == "few" else 40):
            z1, z3, x = rng.normal(size=3) + 2
            z2 = rng.normal() if f == "full" else 7.0 if f == "constant" else 2 * z1 - 3
            x = z1 + z3 if f == "x_is_covariate" else x
            rows.append((f, float(1 + 2 * x + z1 + rng.normal()), float(z1), float(z2), float(z3), float(x)))
    df = spark.createDataFrame(rows, "feature_label string, level double, z1 double, z2 double, z3 double, x double")
    got = {r.feature_label: r for r in ols.regress_features(
        df, ["x"], numeric_covariates=["z1", "z2", "z3"], details=True).collect()}
    for f in got:
        a = np.array([r[1:] for r in rows if r[0] == f])
        _same_fit(got[f], _pinv_fit(np.column_stack([np.ones(len(a)), a[:, 1:]]), a[:, 0]))
    assert got["twice"].LR_Effect_Size is not None and got["x_is_covariate"].LR_Effect_Size is None


@pytest.mark.parametrize("factors", [["a", "b"], ["b", "a", "c"]])
def test_ols_several_factors_equal_dummies(spark, factors):
    rng = np.random.default_rng(len(factors))
    rows = []
    for f, n in (("many", 300), ("sparse", 24), ("blocks", 120), ("x_in_levels", 60)):
        for _ in range(n):
            a, b, c = (int(rng.integers(k)) for k in (9, 4, 3))
            if f == "blocks":  # levels fall into two unconnected halves
                b = b // 2 + (2 if a > 4 else 0)
            x = float(a + 2 * b + 1) if f == "x_in_levels" else float(rng.normal() + 3)
            z = float(rng.normal() + b)
            rows.append((f, float(1000 + 3 * a - b + c + 0.5 * x + z + rng.normal()), f"a{a}", f"b{b}", f"c{c}", z, x))
    rows.append(("many", 1001.0, "once", "b1", "c0", 0.3, 2.5))
    rows += [("many", 1.0, None, "b1", "c0", 0.3, 2.5), ("many", 1.0, "a1", "b1", "c0", 0.3, 0.0)]
    df = spark.createDataFrame(
        rows, "feature_label string, level double, a string, b string, c string, z double, x double")
    got = {r.feature_label: r for r in ols.regress_features(
        df, ["x"], covariate=factors, numeric_covariates=["z"], details=True).collect()}
    assert len(got) == 4
    at = {"a": 2, "b": 3, "c": 4}
    for f in got:
        own = [r for r in rows if r[0] == f and r[2] is not None and r[6] != 0]
        dummies = [[float(r[at[k]] == v) for r in own] for k in factors for v in sorted({r[at[k]] for r in own})]
        X = np.column_stack([np.ones(len(own)), *dummies, [r[5] for r in own], [r[6] for r in own]])
        _same_fit(got[f], _pinv_fit(X, np.array([r[1] for r in own])))
    assert got["many"].LR_Effect_Size is not None and got["x_in_levels"].LR_Effect_Size is None
    assert ols.regress_features(df.limit(0), ["x"], covariate=factors).count() == 0


def test_ols_degenerate_gives_null(spark):
    rows = [("few", "s1", 1.0, 1.0), ("few", "s1", 2.0, 2.0),            # n <= params
            ("flat", "s1", 1.0, 3.0), ("flat", "s1", 2.0, 3.0), ("flat", "s2", 3.0, 3.0),
            ("flat", "s2", 4.0, 3.0)]                                     # constant x
    rows += [("within", "s1", 1.0, 1.0), ("within", "s1", 2.0, 1.0), ("within", "s2", 3.0, 2.0),
             ("within", "s2", 5.0, 2.0)]                                  # x constant in each site
    rows += [("z", "s1", 1.0, 0.0), ("z", "s1", None, 2.0)]               # x == 0 and null level
    df = spark.createDataFrame(rows, "feature_label string, site string, level double, x double")
    res = {r.feature_label: r for r in ols.regress_features(df, ["x"], covariate="site").collect()}
    for f in ("few", "flat", "within"):
        assert res[f].LR_Effect_Size is None and res[f].LR_P_Value is None
    assert "z" not in res  # no complete row left after the x != 0 filter


def test_fused_arm_key_equals_per_arm_runs(spark):
    """Loop fusion must not change results: the by-arm job equals one job per arm."""
    v = fx.visits_long(spark, SF001).withColumn("Visit", F.replace("Visit", F.lit(" "), F.lit("")))
    visits = ("Day0", "Day10", "Day20")
    wide = ttest.pivot_visits(v, id_cols=("Treatment", "metabolite", "animal"), values=visits, on_duplicate="avg")
    fused = {(r.Treatment, r.metabolite, r.time_point): r.statistic
             for r in ttest.paired_t(wide, timepoints=visits[1:], by=["Treatment"]).collect()}
    for arm in ("T01", "T02", "T03"):
        w = ttest.pivot_visits(v.filter(F.col("Treatment") == arm), values=visits, on_duplicate="avg")
        for r in ttest.paired_t(w, timepoints=visits[1:]).collect():
            assert fused[(arm, r.metabolite, r.time_point)] == pytest.approx(r.statistic, nan_ok=True)
    welch = {(r.Treatment, r.Visit, r.metabolite): r.p_value
             for r in ttest.welch_by_group(v, by=["Treatment", "Visit"]).collect()}
    for r in ttest.welch_by_group(v.filter(F.col("Treatment") == "T02"), by=["Visit"]).collect():
        assert welch[("T02", r.Visit, r.metabolite)] == pytest.approx(r.p_value)
