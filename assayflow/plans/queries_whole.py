"""Whole-table forms of the queries that look at one year or one arm: the time
point or the arm is a key, and every row reaches the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.functions import clean_visit
from assayflow.functions.tdist import sql_t_two_sided_p, t_two_sided_p
from assayflow.operators import foldchange, multiple, ols, ttest, volcano
from assayflow.operators.report import round_doubles
from assayflow.plans import fixtures as fx
from assayflow.plans import sqlkit as sk
from assayflow.plans.queries import (
    _ALL_MOM, _ALL_SRC, _ALL_TP_SRC, _FDR, _PIVOT_ALL, _STACK_ALL, _assay_tp, _ols_oracle_all, _volcano_all_sql,
    BASELINE, FOLLOWUPS, HIGHLIGHT, SWEEP_VARIABLES, VISITS,
)
from assayflow.plans.registry import register

_TP = ["time_point"]
_TP_VARIABLE = ["time_point", "independent_variable"]
_ARM_VISIT = ["Treatment", "Visit"]


def _fits(spark, d, variables=("x_quantity",), covariate="site", **kw):
    return ols.regress_features(_assay_tp(spark, d), list(variables), covariate=covariate, by=_TP, **kw)


def _arms(spark, d):
    return fx.visits_long(spark, d).withColumn("Visit", clean_visit("Visit"))


def _wide(spark, d):
    return ttest.pivot_visits(_arms(spark, d), id_cols=("Treatment", "metabolite", "animal"), values=VISITS,
                              on_duplicate="avg")


# --- regression --------------------------------------------------------------
@register("ols_categorical_covariate_all_time_points", _ols_oracle_all(["x_quantity"], categorical="site"))
def ols_categorical_covariate_all_time_points(spark: SparkSession, d: str) -> DataFrame:
    """M1: level ~ C(site) + x_quantity per (time point, feature)."""
    return round_doubles(_fits(spark, d, details=True))


@register("ols_numeric_covariate_all_time_points", _ols_oracle_all(["x_quantity"], numeric=["site_num"]))
def ols_numeric_covariate_all_time_points(spark: SparkSession, d: str) -> DataFrame:
    """M1: level ~ site_num + x_quantity per (time point, feature)."""
    return round_doubles(_fits(spark, d, covariate="site_num", details=True))


@register("ols_multi_covariate_all_time_points", _ols_oracle_all(
    ["x_quantity"], categorical="site", numeric=["site_num", "x_acctbal"]))
def ols_multi_covariate_all_time_points(spark: SparkSession, d: str) -> DataFrame:
    """Site dummies + two numeric covariates + x per (time point, feature)."""
    return round_doubles(_fits(spark, d, numeric_covariates=["site_num", "x_acctbal"], details=True))


@register("ols_collinear_covariates", _ols_oracle_all(
    ["x_quantity"], categorical="site", numeric=["site_num", "x_acctbal"]))
def ols_collinear_covariates(spark: SparkSession, d: str) -> DataFrame:
    """M1/U1 of deficient rank: one covariate is a combination of another and
    the intercept; the fits are those without it."""
    assay = _assay_tp(spark, d).withColumn("site_again", 2 * F.col("site_num") + 1)
    return round_doubles(ols.regress_features(
        assay, ["x_quantity"], covariate="site", numeric_covariates=["site_num", "site_again", "x_acctbal"],
        by=_TP, details=True))


_SITES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _two_factors_sql():
    dummies = ", ".join(f"CASE WHEN site = '{v}' THEN 1 ELSE 0 END AS in_{v.lower()}" for v in _SITES)
    body, ctes = sk.ols_sql("src", ["x_quantity"], categorical="time_point",
                            numeric=[f"in_{v.lower()}" for v in _SITES])
    return fx.with_views(body, "assay_long", extra={
        "src": f"SELECT metabolite AS feature_label, level, time_point, x_quantity, {dummies} FROM assay_long", **ctes})


@register("ols_two_factors", _two_factors_sql())
def ols_two_factors(spark: SparkSession, d: str) -> DataFrame:
    """M1/U1 with a list of string covariates: level ~ C(time_point) + C(site)
    + x_quantity per feature (the twin spells out the dummies)."""
    return round_doubles(ols.regress_features(
        _assay_tp(spark, d), ["x_quantity"], covariate=["time_point", "site"], details=True))


def _ci_sql():
    body, ctes = sk.ols_sql("src", ["x_quantity"], categorical="site", rounded=False, by=_TP)
    tail = lambda a, b: sk.r(sql_t_two_sided_p(f"(({a} - {b}) / std_err)", "df"))
    final = (f"SELECT time_point, feature_label, independent_variable, {sk.r('LR_CI_Lower')} AS LR_CI_Lower, "
             f"{sk.r('LR_CI_Upper')} AS LR_CI_Upper, {tail('LR_Effect_Size', 'LR_CI_Lower')} AS tail_at_lower, "
             f"{tail('LR_CI_Upper', 'LR_Effect_Size')} AS tail_at_upper FROM o")
    return fx.with_views(final, "assay_long", extra={"src": _ALL_TP_SRC, **ctes, "o": body})


@register("ols_ci_all_time_points", _ci_sql())
def ols_ci_all_time_points(spark: SparkSession, d: str) -> DataFrame:
    """M1 confidence interval (X11) per (time point, feature), with the tail at each bound."""
    res = _fits(spark, d, details=True)
    res = (res.withColumn("_tl", (F.col("LR_Effect_Size") - F.col("LR_CI_Lower")) / F.col("std_err"))
              .withColumn("_tu", (F.col("LR_CI_Upper") - F.col("LR_Effect_Size")) / F.col("std_err")))
    return round_doubles(res.select(
        "time_point", "feature_label", "independent_variable", "LR_CI_Lower", "LR_CI_Upper",
        t_two_sided_p("_tl", "df").alias("tail_at_lower"), t_two_sided_p("_tu", "df").alias("tail_at_upper")))


# --- multiple testing ----------------------------------------------------------
_ob, _oc = sk.ols_sql("src", list(SWEEP_VARIABLES), categorical="site", rounded=False, by=_TP)
_OLS_BH = {"src": _ALL_TP_SRC, **_oc, "o": _ob,
           "bh": sk.bh_sql("o", p="LR_P_Value", by=_TP_VARIABLE, order_key="feature_label"),
           "thr": ("SELECT time_point, independent_variable, coalesce(min(CASE WHEN p_bh >= "
                   f"{_FDR} THEN LR_P_Value END), 'Infinity'::DOUBLE) AS p_threshold "
                   "FROM bh GROUP BY time_point, independent_variable")}
_ON_THR = "t.time_point = b.time_point AND t.independent_variable = b.independent_variable"


@register("fdr_threshold_all_time_points", fx.with_views(
    f"SELECT t.time_point, t.independent_variable, {sk.r('t.p_threshold')} AS p_threshold, "
    "count(DISTINCT CASE WHEN b.LR_P_Value < t.p_threshold THEN b.feature_label END) AS n_significant "
    f"FROM thr t JOIN bh b ON {_ON_THR} GROUP BY t.time_point, t.independent_variable, t.p_threshold",
    "assay_long", extra=_OLS_BH))
def fdr_threshold_all_time_points(spark: SparkSession, d: str) -> DataFrame:
    """M7 + G14 per (time point, independent variable)."""
    adj = multiple.bh_adjust(_fits(spark, d, SWEEP_VARIABLES), p="LR_P_Value", by=_TP_VARIABLE)
    return round_doubles(multiple.fdr_threshold(
        adj, p="LR_P_Value", by=_TP_VARIABLE, fdr=_FDR, feature="feature_label"))


@register("feature_class_all_time_points", fx.with_views(
    f"SELECT b.time_point, b.feature_label, b.independent_variable, {sk.r('b.LR_P_Value')} AS LR_P_Value, "
    f"{sk.r('b.LR_Effect_Size')} AS LR_Effect_Size, {sk.r('b.p_bh')} AS p_bh, "
    f"{sk.r('t.p_threshold')} AS p_threshold, "
    "CASE WHEN b.feature_label IN (" + ", ".join(f"'{h}'" for h in HIGHLIGHT) + ") THEN 'PD biomarkers' "
    "WHEN b.LR_P_Value < t.p_threshold THEN 'significant biomarkers' ELSE 'total biomarkers' END AS \"group\", "
    + sk.r("CASE WHEN b.LR_P_Value = 0 THEN 'Infinity'::DOUBLE WHEN b.LR_P_Value > 0 THEN -log10(b.LR_P_Value) END")
    + f" AS neg_log10_p FROM bh b JOIN thr t ON {_ON_THR}",
    "assay_long", extra=_OLS_BH))
def feature_class_all_time_points(spark: SparkSession, d: str) -> DataFrame:
    """M15 per (time point, independent variable)."""
    cls = volcano.feature_classes(_fits(spark, d, SWEEP_VARIABLES), by=_TP_VARIABLE, highlight=HIGHLIGHT, fdr=_FDR)
    return round_doubles(cls.select("time_point", "feature_label", "independent_variable", "LR_P_Value",
                                    "LR_Effect_Size", "p_bh", "p_threshold", "group", "neg_log10_p"))


_WELCH = sk.ttest_finish("mom", [*_ARM_VISIT, "metabolite"], **sk.welch_parts(nother="nother"),
                         method=ttest.WELCH_METHOD, rounded=False)


@register("bh_adjust_all_arms", fx.with_views(
    f"SELECT Treatment, Visit, metabolite, {sk.r('p_value')} AS p_value, {sk.r('p_bh')} AS p_bh FROM bh",
    "visits_long", extra={"src": _ALL_SRC, "mom": _ALL_MOM, "w": _WELCH,
                          "bh": sk.bh_sql("w", p="p_value", by=_ARM_VISIT, order_key="metabolite")}))
def bh_adjust_all_arms(spark: SparkSession, d: str) -> DataFrame:
    """M6 per (arm, visit) over the Welch results of every arm."""
    res = multiple.bh_adjust(ttest.welch_by_group(_arms(spark, d), by=_ARM_VISIT), p="p_value", by=_ARM_VISIT)
    return round_doubles(res.select("Treatment", "Visit", "metabolite", "p_value", "p_bh"))


@register("significant_count_all_arms", _volcano_all_sql(
    "SELECT Treatment, Visit, count(*) AS n_rows, count(CASE WHEN P < 0.0001 THEN 1 END) AS n_p_significant, "
    "count(CASE WHEN p_bh < 0.1 THEN 1 END) AS n_bh_significant FROM vol GROUP BY Treatment, Visit"))
def significant_count_all_arms(spark: SparkSession, d: str) -> DataFrame:
    """F7 per (arm, visit): rows and counts under P < 1e-4 and p_bh < 0.1."""
    v = _arms(spark, d)
    vol = volcano.volcano_table(ttest.welch_by_group(v, by=_ARM_VISIT), foldchange.fold_change_groups(v, by=_ARM_VISIT),
                                by=_ARM_VISIT, sig_column="P", threshold=1e-4)
    return volcano.significance_counts(vol, by=_ARM_VISIT)


# --- visits --------------------------------------------------------------------
@register("pivot_visit_zero_fill_all_arms", fx.with_views(
    "SELECT Treatment, metabolite, animal, " + ", ".join(f"{sk.r(v)} AS {v}" for v in VISITS) + " FROM wide",
    "visits_long", extra={"wide": _PIVOT_ALL}))
def pivot_visit_zero_fill_all_arms(spark: SparkSession, d: str) -> DataFrame:
    """R3 with the arm as a key: long -> wide by visit, absent visits filled with 0."""
    return round_doubles(_wide(spark, d))


_FOLD = {
    "med": ("SELECT Treatment, metabolite, Visit, median(level) AS m FROM src "
            f"WHERE Visit IN ({', '.join(repr(v) for v in VISITS)}) GROUP BY Treatment, metabolite, Visit"),
    "fvw": ("SELECT Treatment, metabolite, " + ", ".join(
        f"max(CASE WHEN Visit = '{v}' THEN m END) AS m_{v}" for v in VISITS)
        + " FROM med GROUP BY Treatment, metabolite"),
    "fvr": " UNION ALL ".join(
        f"SELECT Treatment, metabolite, '{tp}' AS time_point, m_{BASELINE} AS baseline_median, m_{tp} AS visit_median "
        "FROM fvw" for tp in FOLLOWUPS),
    "fv": f"SELECT *, {sk.fc_cols('visit_median', 'baseline_median')} FROM fvr",
}
_FOLD_COLUMNS = ("baseline_median", "visit_median", "fold_change", "log2_fold_change")


@register("fold_change_visits_all_arms", fx.with_views(
    "SELECT Treatment, metabolite, time_point, " + ", ".join(f"{sk.r(c)} AS {c}" for c in _FOLD_COLUMNS) + " FROM fv",
    "visits_long", extra={"src": _ALL_SRC, **_FOLD}))
def fold_change_visits_all_arms(spark: SparkSession, d: str) -> DataFrame:
    """M9 with the arm as a key: median(visit) / median(Day0) per (arm, feature)."""
    return round_doubles(foldchange.fold_change_visits(
        _arms(spark, d), baseline=BASELINE, timepoints=FOLLOWUPS, by=["Treatment"]))


_KEYS = ["Treatment", "metabolite", "time_point"]
_PAIRED = sk.ttest_finish(
    "mom", _KEYS, est="m", se="sqrt(v / n)", dof="cast(n - 1 AS double)",
    status=(f"CASE WHEN n < 2 THEN 'not_enough_x' WHEN sqrt(v / n) <= 0 OR "
            f"sqrt(v / n) < 10 * {sk.EPS} * abs(m) THEN 'constant' ELSE 'ok' END"),
    method=ttest.PAIRED_METHOD)


@register("stats_fc_outer_all_arms", fx.with_views(
    "SELECT " + ", ".join(f"coalesce(p.{k}, f.{k}) AS {k}" for k in _KEYS)
    + ", p.estimate, p.statistic, p.p_value, p.parameter, p.conf_low, p.conf_high, p.method, p.alternative, p.status, "
    + ", ".join(f"{sk.r(f'f.{c}')} AS {c}" for c in _FOLD_COLUMNS)
    + " FROM pt p FULL OUTER JOIN fv f ON " + " AND ".join(f"p.{k} = f.{k}" for k in _KEYS),
    "visits_long", extra={
        "src": _ALL_SRC, "wide": _PIVOT_ALL, "st": _STACK_ALL,
        "mom": ("SELECT Treatment, metabolite, time_point, count(x - y) AS n, avg(x - y) AS m, "
                "var_samp(x - y) AS v FROM st GROUP BY Treatment, metabolite, time_point"),
        "pt": _PAIRED, **_FOLD}))
def stats_fc_outer_all_arms(spark: SparkSession, d: str) -> DataFrame:
    """J3 with the arm as a key: paired-test statistics full-outer-joined with visit fold changes."""
    stats = ttest.paired_t(_wide(spark, d), baseline=BASELINE, timepoints=FOLLOWUPS, by=["Treatment"])
    fc = foldchange.fold_change_visits(_arms(spark, d), baseline=BASELINE, timepoints=FOLLOWUPS, by=["Treatment"])
    return round_doubles(volcano.stats_with_fold_change(stats, fc, keys=_KEYS))
