"""Registered queries: one per operator of the inventory, each a Spark
DataFrame builder ``fn(spark, sf_dir)`` over the whole driver tables, with
an independent DuckDB SQL twin where the semantics are SQL-expressible.

Floating outputs of the registered queries are rounded to 6 decimals
(``report.round_doubles``) so that results exchanged between engines are
comparable; the operators themselves keep full precision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.functions.scalar import clean_visit
from assayflow.operators import foldchange, multiple, ols, ttest, volcano
from assayflow.operators.report import round_doubles
from assayflow.plans import fixtures as fx
from assayflow.plans import sqlkit as sk
from assayflow.plans.registry import register

# Fixed study parameters used by the registered queries.
PLACEBO, TREATED = "T01", "T03"
VISITS = ("Day0", "Day10", "Day20")
BASELINE, FOLLOWUPS = "Day0", ("Day10", "Day20")


# --- t-tests (M3-M5, R3, X2) -----------------------------------------------

def _visits_clean(spark, d, treatment):
    return (fx.visits_long(spark, d)
            .filter(F.col("Treatment") == treatment)
            .withColumn("Visit", clean_visit("Visit")))


def _sql_visits_clean(treatment):
    return (f"SELECT metabolite, animal, replace(Visit, ' ', '') AS Visit, Treatment, Progressive, level "
            f"FROM visits_long WHERE Treatment = '{treatment}'")


_welch = sk.welch_parts(nother="nother")
_WELCH_SQL = fx.with_views(
    sk.ttest_finish("mom", ["Visit", "metabolite"], **_welch, method=ttest.WELCH_METHOD,
                    extra=[("m0", "estimate1"), ("m1", "estimate2")]),
    "visits_long",
    extra={
        "src": _sql_visits_clean(PLACEBO),
        "mom": ("SELECT Visit, metabolite, "
                + sk.welch_moments("Progressive = 0", "Progressive = 1", "level")
                + ", count(CASE WHEN Progressive NOT IN (0, 1) THEN 1 END) AS nother "
                "FROM src WHERE level IS NOT NULL AND Progressive IS NOT NULL "
                "GROUP BY Visit, metabolite"),
    },
)


@register("welch_by_feature", _WELCH_SQL)
def welch_by_feature(spark: SparkSession, d: str) -> DataFrame:
    """M3 (+F2, X2, P7, R5): placebo arm, Welch t of level ~ Progressive per
    metabolite and visit - all visits in one aggregation."""
    v = _visits_clean(spark, d, PLACEBO)
    return round_doubles(ttest.welch_by_group(v, by=["Visit"]))


_WELCH_ALL_SQL = fx.with_views(
    sk.ttest_finish("mom", ["Treatment", "Visit", "metabolite"], **sk.welch_parts(nother="nother"),
                    method=ttest.WELCH_METHOD, extra=[("m0", "estimate1"), ("m1", "estimate2")]),
    "visits_long",
    extra={
        "src": ("SELECT metabolite, animal, replace(Visit, ' ', '') AS Visit, Treatment, "
                "Progressive, level FROM visits_long"),
        "mom": ("SELECT Treatment, Visit, metabolite, "
                + sk.welch_moments("Progressive = 0", "Progressive = 1", "level")
                + ", count(CASE WHEN Progressive NOT IN (0, 1) THEN 1 END) AS nother "
                "FROM src WHERE level IS NOT NULL AND Progressive IS NOT NULL "
                "GROUP BY Treatment, Visit, metabolite"),
    },
)


@register("welch_all_arms", _WELCH_ALL_SQL)
def welch_all_arms(spark: SparkSession, d: str) -> DataFrame:
    """M3 with the arm loop fused as well: Welch t per (arm, visit, feature)
    over the whole long table in one aggregation."""
    v = fx.visits_long(spark, d).withColumn("Visit", clean_visit("Visit"))
    return round_doubles(ttest.welch_by_group(v, by=["Treatment", "Visit"]))


def _sql_pivot(treatment):
    cols = ", ".join(
        f"CASE WHEN count(CASE WHEN Visit = '{v}' THEN 1 END) = 0 THEN 0.0 "
        f"ELSE avg(CASE WHEN Visit = '{v}' THEN level END) END AS {v}" for v in VISITS)
    return (f"SELECT metabolite, animal, {cols} FROM ({_sql_visits_clean(treatment)}) s "
            f"GROUP BY metabolite, animal")


@register("pivot_visit_zero_fill", fx.with_views(
    "SELECT metabolite, animal, " + ", ".join(f"{sk.r(v)} AS {v}" for v in VISITS) + " FROM wide",
    "visits_long", extra={"wide": _sql_pivot(TREATED)}))
def pivot_visit_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    """Treated arm, long -> wide by visit, absent visits filled with 0."""
    return round_doubles(ttest.pivot_visits(_visits_clean(spark, d, TREATED), values=VISITS, on_duplicate="avg"))


def _sql_stack(tps):
    parts = [f"SELECT metabolite, '{tp}' AS time_point, {BASELINE} AS x, {tp} AS y FROM wide"
             for tp in tps]
    return " UNION ALL ".join(parts)


_PAIRED_SQL = fx.with_views(
    sk.ttest_finish(
        "mom", ["metabolite", "time_point"], est="m",
        se="sqrt(v / n)", dof="cast(n - 1 AS double)",
        status=(f"CASE WHEN n < 2 THEN 'not_enough_x' WHEN sqrt(v / n) <= 0 OR "
                f"sqrt(v / n) < 10 * {sk.EPS} * abs(m) THEN 'constant' ELSE 'ok' END"),
        method=ttest.PAIRED_METHOD),
    "visits_long",
    extra={
        "wide": _sql_pivot(TREATED),
        "st": _sql_stack(FOLLOWUPS),
        "mom": ("SELECT metabolite, time_point, count(x - y) AS n, avg(x - y) AS m, "
                "var_samp(x - y) AS v FROM st GROUP BY metabolite, time_point"),
    },
)


@register("paired_t", _PAIRED_SQL)
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    """M4: treated arm, paired t Day0 vs each later visit, zero-filled cells."""
    wide = ttest.pivot_visits(_visits_clean(spark, d, TREATED), values=VISITS, on_duplicate="avg")
    return round_doubles(ttest.paired_t(wide, baseline=BASELINE, timepoints=FOLLOWUPS))


_UNPAIRED_SQL = fx.with_views(
    sk.ttest_finish("mom", ["metabolite", "time_point"], **sk.welch_parts(),
                    method=ttest.WELCH_METHOD),
    "visits_long",
    extra={
        "wide": _sql_pivot(TREATED),
        "st": _sql_stack(FOLLOWUPS),
        "mom": ("SELECT metabolite, time_point, count(x) AS n0, avg(x) AS m0, var_samp(x) AS v0, "
                "count(y) AS n1, avg(y) AS m1, var_samp(y) AS v1 "
                "FROM st GROUP BY metabolite, time_point"),
    },
)


@register("unpaired_t", _UNPAIRED_SQL)
def unpaired_t(spark: SparkSession, d: str) -> DataFrame:
    """M5: treated arm, Welch t of the Day0 column vs each later visit column."""
    wide = ttest.pivot_visits(_visits_clean(spark, d, TREATED), values=VISITS, on_duplicate="avg")
    return round_doubles(ttest.unpaired_t(wide, baseline=BASELINE, timepoints=FOLLOWUPS))


_PIVOT_ALL = (
    "SELECT Treatment, metabolite, animal, " + ", ".join(
        f"CASE WHEN count(CASE WHEN Visit = '{v}' THEN 1 END) = 0 THEN 0.0 "
        f"ELSE avg(CASE WHEN Visit = '{v}' THEN level END) END AS {v}" for v in VISITS)
    + " FROM (SELECT metabolite, animal, replace(Visit, ' ', '') AS Visit, Treatment, level "
      "FROM visits_long) s GROUP BY Treatment, metabolite, animal")
_STACK_ALL = " UNION ALL ".join(
    f"SELECT Treatment, metabolite, '{tp}' AS time_point, {BASELINE} AS x, {tp} AS y FROM wide"
    for tp in FOLLOWUPS)


@register("paired_t_all_arms", fx.with_views(
    sk.ttest_finish(
        "mom", ["Treatment", "metabolite", "time_point"], est="m",
        se="sqrt(v / n)", dof="cast(n - 1 AS double)",
        status=(f"CASE WHEN n < 2 THEN 'not_enough_x' WHEN sqrt(v / n) <= 0 OR "
                f"sqrt(v / n) < 10 * {sk.EPS} * abs(m) THEN 'constant' ELSE 'ok' END"),
        method=ttest.PAIRED_METHOD),
    "visits_long",
    extra={"wide": _PIVOT_ALL, "st": _STACK_ALL,
           "mom": ("SELECT Treatment, metabolite, time_point, count(x - y) AS n, avg(x - y) AS m, "
                   "var_samp(x - y) AS v FROM st GROUP BY Treatment, metabolite, time_point")}))
def paired_t_all_arms(spark: SparkSession, d: str) -> DataFrame:
    """M4 with the arm as a key: paired t per (arm, feature, later visit)
    over the whole long table."""
    v = fx.visits_long(spark, d).withColumn("Visit", clean_visit("Visit"))
    wide = ttest.pivot_visits(v, id_cols=("Treatment", "metabolite", "animal"), values=VISITS, on_duplicate="avg")
    return round_doubles(ttest.paired_t(wide, baseline=BASELINE, timepoints=FOLLOWUPS,
                                        by=["Treatment"]))


@register("unpaired_t_all_arms", fx.with_views(
    sk.ttest_finish("mom", ["Treatment", "metabolite", "time_point"], **sk.welch_parts(),
                    method=ttest.WELCH_METHOD),
    "visits_long",
    extra={"wide": _PIVOT_ALL, "st": _STACK_ALL,
           "mom": ("SELECT Treatment, metabolite, time_point, count(x) AS n0, avg(x) AS m0, "
                   "var_samp(x) AS v0, count(y) AS n1, avg(y) AS m1, var_samp(y) AS v1 "
                   "FROM st GROUP BY Treatment, metabolite, time_point")}))
def unpaired_t_all_arms(spark: SparkSession, d: str) -> DataFrame:
    """M5 with the arm as a key: Welch t of Day0 vs each later visit column
    per (arm, feature) over the whole long table."""
    v = fx.visits_long(spark, d).withColumn("Visit", clean_visit("Visit"))
    wide = ttest.pivot_visits(v, id_cols=("Treatment", "metabolite", "animal"), values=VISITS, on_duplicate="avg")
    return round_doubles(ttest.unpaired_t(wide, baseline=BASELINE, timepoints=FOLLOWUPS,
                                          by=["Treatment"]))


# --- regression (M1, M2, U1, P1, P2, F1, G4) ------------------------------

TIME_POINT = "1996"
SWEEP_VARIABLES = ("x_discount", "x_quantity", "x_acctbal")


def _assay_tp(spark, d):
    return fx.assay_long(spark, d).withColumnRenamed("metabolite", "feature_label")


_OLS_SRC = (f"SELECT metabolite AS feature_label, level, site, site_num, x_discount, x_quantity, "
            f"x_acctbal FROM assay_long WHERE time_point = '{TIME_POINT}'")


def _ols_oracle(ivs, **kw):
    body, ctes = sk.ols_sql("src", ivs, **kw)
    return fx.with_views(body, "assay_long", extra={"src": _OLS_SRC, **ctes})


@register("ols_categorical_covariate", _ols_oracle(["x_quantity"], categorical="site"))
def ols_categorical_covariate(spark: SparkSession, d: str) -> DataFrame:
    """M1: level ~ C(site) + x_quantity per brand at one time point."""
    return round_doubles(ols.regress_features(
        _assay_tp(spark, d), ["x_quantity"], covariate="site", time_point=TIME_POINT,
        details=True))


@register("ols_numeric_covariate", _ols_oracle(["x_quantity"], numeric=["site_num"]))
def ols_numeric_covariate(spark: SparkSession, d: str) -> DataFrame:
    """M1: level ~ site_num + x_quantity (numeric covariate enters linearly)."""
    return round_doubles(ols.regress_features(
        _assay_tp(spark, d), ["x_quantity"], covariate="site_num", time_point=TIME_POINT,
        details=True))


@register("ols_sweep", _ols_oracle(list(SWEEP_VARIABLES), categorical="site"))
def ols_sweep(spark: SparkSession, d: str) -> DataFrame:
    """M2: the variable sweep as one job (x == 0 rows dropped per variable)."""
    return round_doubles(ols.regress_features(
        _assay_tp(spark, d), list(SWEEP_VARIABLES), covariate="site", time_point=TIME_POINT,
        details=True))


_ALL_TP_SRC = ("SELECT time_point, metabolite AS feature_label, level, site, site_num, x_discount, "
               "x_quantity, x_acctbal FROM assay_long")


def _ols_oracle_all(ivs, **kw):
    body, ctes = sk.ols_sql("src", ivs, by=["time_point"], **kw)
    return fx.with_views(body, "assay_long", extra={"src": _ALL_TP_SRC, **ctes})


@register("ols_sweep_all_time_points", _ols_oracle_all(list(SWEEP_VARIABLES), categorical="site"))
def ols_sweep_all_time_points(spark: SparkSession, d: str) -> DataFrame:
    """M2 with the time-point loop fused too: every (time point, variable,
    feature) model over the whole table in one job."""
    return round_doubles(ols.regress_features(
        _assay_tp(spark, d), list(SWEEP_VARIABLES), covariate="site", by=["time_point"],
        details=True))


def _ols_ci_sql():
    body, ctes = sk.ols_sql("src", ["x_quantity"], categorical="site", rounded=False)
    from assayflow.functions.tdist import sql_t_two_sided_p
    final = ("SELECT feature_label, independent_variable, round(LR_CI_Lower, 6) AS LR_CI_Lower, "
             "round(LR_CI_Upper, 6) AS LR_CI_Upper, "
             f"round({sql_t_two_sided_p('((LR_Effect_Size - LR_CI_Lower) / std_err)', 'df')}, 6) "
             "AS tail_at_lower, "
             f"round({sql_t_two_sided_p('((LR_CI_Upper - LR_Effect_Size) / std_err)', 'df')}, 6) "
             "AS tail_at_upper FROM o")
    return fx.with_views(final, "assay_long", extra={"src": _OLS_SRC, **ctes, "o": body})


@register("ols_ci", _ols_ci_sql())
def ols_ci(spark: SparkSession, d: str) -> DataFrame:
    """M1 confidence interval (X11 quantile): the bounds, and the two-sided
    t tail at each bound - 0.05 by construction of the 95% interval."""
    from assayflow.functions.tdist import t_two_sided_p
    res = ols.regress_features(_assay_tp(spark, d), ["x_quantity"], covariate="site",
                               time_point=TIME_POINT, details=True)
    res = (res.withColumn("_tl", (F.col("LR_Effect_Size") - F.col("LR_CI_Lower")) / F.col("std_err"))
              .withColumn("_tu", (F.col("LR_CI_Upper") - F.col("LR_Effect_Size")) / F.col("std_err")))
    return round_doubles(res.select(
        "feature_label", "independent_variable", "LR_CI_Lower", "LR_CI_Upper",
        t_two_sided_p("_tl", "df").alias("tail_at_lower"),
        t_two_sided_p("_tu", "df").alias("tail_at_upper")))


@register("ols_multi_covariate", _ols_oracle(["x_quantity"], categorical="site",
                                             numeric=["site_num", "x_acctbal"]))
def ols_multi_covariate(spark: SparkSession, d: str) -> DataFrame:
    """Site dummies + two numeric covariates + x (three slope terms,
    closed form per feature)."""
    return round_doubles(ols.regress_features(
        _assay_tp(spark, d), ["x_quantity"], covariate="site",
        numeric_covariates=["site_num", "x_acctbal"], time_point=TIME_POINT, details=True))


# --- multiple testing, fold change, volcano (M6-M9, M14-M16, R2, G6, G14, F7, J3) ---

def _welch_ctes(rounded: bool) -> tuple[str, dict[str, str]]:
    body = sk.ttest_finish("mom", ["Visit", "metabolite"], **sk.welch_parts(nother="nother"),
                           method=ttest.WELCH_METHOD, rounded=rounded,
                           extra=[("m0", "estimate1"), ("m1", "estimate2")])
    return body, {
        "src": _sql_visits_clean(PLACEBO),
        "mom": ("SELECT Visit, metabolite, "
                + sk.welch_moments("Progressive = 0", "Progressive = 1", "level")
                + ", count(CASE WHEN Progressive NOT IN (0, 1) THEN 1 END) AS nother "
                "FROM src WHERE level IS NOT NULL AND Progressive IS NOT NULL "
                "GROUP BY Visit, metabolite"),
    }


def _welch_full(spark, d):
    return ttest.welch_by_group(_visits_clean(spark, d, PLACEBO), by=["Visit"])


_wb, _wc = _welch_ctes(rounded=False)


@register("bh_adjust", fx.with_views(
    "SELECT Visit, metabolite, round(p_value, 6) AS p_value, round(p_bh, 6) AS p_bh FROM bh",
    "visits_long", extra={**_wc, "w": _wb,
                          "bh": sk.bh_sql("w", p="p_value", by=["Visit"], order_key="metabolite")}))
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    """M6: Benjamini-Hochberg per visit over the placebo Welch results."""
    res = multiple.bh_adjust(_welch_full(spark, d), p="p_value", by=["Visit"])
    return round_doubles(res.select("Visit", "metabolite", "p_value", "p_bh"))


_ob, _oc = sk.ols_sql("src", list(SWEEP_VARIABLES), categorical="site", rounded=False)
_FDR = 0.1
_OLS_BH = {"src": _OLS_SRC, **_oc, "o": _ob,
           "bh": sk.bh_sql("o", p="LR_P_Value", by=["independent_variable"],
                           order_key="feature_label"),
           "thr": ("SELECT independent_variable, coalesce(min(CASE WHEN p_bh >= "
                   f"{_FDR} THEN LR_P_Value END), 'Infinity'::DOUBLE) AS p_threshold "
                   "FROM bh GROUP BY independent_variable")}


@register("fdr_threshold", fx.with_views(
    "SELECT t.independent_variable, round(t.p_threshold, 6) AS p_threshold, "
    "count(DISTINCT CASE WHEN b.LR_P_Value < t.p_threshold THEN b.feature_label END) AS n_significant "
    "FROM thr t JOIN bh b ON t.independent_variable = b.independent_variable "
    "GROUP BY t.independent_variable, t.p_threshold",
    "assay_long", extra=_OLS_BH))
def fdr_threshold(spark: SparkSession, d: str) -> DataFrame:
    """M7 + G14: raw-p cut-off for FDR 0.1 per independent variable and the
    number of distinct significant features."""
    res = ols.regress_features(_assay_tp(spark, d), list(SWEEP_VARIABLES), covariate="site",
                               time_point=TIME_POINT)
    adj = multiple.bh_adjust(res, p="LR_P_Value", by=["independent_variable"])
    return round_doubles(multiple.fdr_threshold(
        adj, p="LR_P_Value", by=["independent_variable"], fdr=_FDR, feature="feature_label"))


HIGHLIGHT = ("Brand#11", "Brand#23", "Brand#35")


@register("feature_class", fx.with_views(
    "SELECT b.feature_label, b.independent_variable, round(b.LR_P_Value, 6) AS LR_P_Value, "
    "round(b.LR_Effect_Size, 6) AS LR_Effect_Size, round(b.p_bh, 6) AS p_bh, "
    "round(t.p_threshold, 6) AS p_threshold, "
    "CASE WHEN b.feature_label IN (" + ", ".join(f"'{h}'" for h in HIGHLIGHT) + ") THEN 'PD biomarkers' "
    "WHEN b.LR_P_Value < t.p_threshold THEN 'significant biomarkers' ELSE 'total biomarkers' END AS \"group\", "
    "round(CASE WHEN b.LR_P_Value = 0 THEN 'Infinity'::DOUBLE WHEN b.LR_P_Value > 0 "
    "THEN -log10(b.LR_P_Value) END, 6) AS neg_log10_p "
    "FROM bh b JOIN thr t ON b.independent_variable = t.independent_variable",
    "assay_long", extra=_OLS_BH))
def feature_class(spark: SparkSession, d: str) -> DataFrame:
    """Highlighted / significant / total class per feature and variable."""
    res = ols.regress_features(_assay_tp(spark, d), list(SWEEP_VARIABLES), covariate="site",
                               time_point=TIME_POINT)
    cls = volcano.feature_classes(res, highlight=HIGHLIGHT, fdr=_FDR)
    return round_doubles(cls.select("feature_label", "independent_variable", "LR_P_Value",
                                    "LR_Effect_Size", "p_bh", "p_threshold", "group",
                                    "neg_log10_p"))


_FCG_SQL = sk.median_pivot_sql("src", keys=["Visit", "metabolite"], group="Progressive",
                               value="level", groups=(0, 1),
                               labels=("non_progressive", "progressive"))


@register("fold_change_groups", fx.with_views(
    "SELECT Visit, metabolite, round(non_progressive, 6) AS non_progressive, "
    "round(progressive, 6) AS progressive, round(fold_change, 6) AS fold_change, "
    "round(log2_fold_change, 6) AS log2_fold_change FROM (SELECT *, "
    + sk.fc_cols("progressive", "non_progressive") + " FROM fcw) z",
    "visits_long", extra={"src": _sql_visits_clean(PLACEBO), "fcw": _FCG_SQL}))
def fold_change_groups(spark: SparkSession, d: str) -> DataFrame:
    """M8: median(progressive) / median(non-progressive) per feature and visit
    (placebo arm), log2."""
    return round_doubles(foldchange.fold_change_groups(
        _visits_clean(spark, d, PLACEBO), by=["Visit"]))


@register("fold_change_groups_all_arms", fx.with_views(
    "SELECT Treatment, Visit, metabolite, round(non_progressive, 6) AS non_progressive, "
    "round(progressive, 6) AS progressive, round(fold_change, 6) AS fold_change, "
    "round(log2_fold_change, 6) AS log2_fold_change FROM (SELECT *, "
    + sk.fc_cols("progressive", "non_progressive") + " FROM fcw) z",
    "visits_long", extra={
        "src": ("SELECT metabolite, animal, replace(Visit, ' ', '') AS Visit, Treatment, "
                "Progressive, level FROM visits_long"),
        "fcw": sk.median_pivot_sql("src", keys=["Treatment", "Visit", "metabolite"],
                                   group="Progressive", value="level", groups=(0, 1),
                                   labels=("non_progressive", "progressive"))}))
def fold_change_groups_all_arms(spark: SparkSession, d: str) -> DataFrame:
    """M8 with the arm as a key: group-median fold change per (arm, visit,
    feature) over the whole long table."""
    v = fx.visits_long(spark, d).withColumn("Visit", clean_visit("Visit"))
    return round_doubles(foldchange.fold_change_groups(v, by=["Treatment", "Visit"]))


@register("pivot_group_median", fx.with_views(
    "SELECT Treatment, Visit, metabolite, round(non_progressive, 6) AS non_progressive, "
    "round(progressive, 6) AS progressive FROM pm",
    "visits_long", extra={"pm": sk.median_pivot_sql(
        "visits_long", keys=["Treatment", "Visit", "metabolite"], group="Progressive",
        value="level", groups=(0, 1), labels=("non_progressive", "progressive"))}))
def pivot_group_median(spark: SparkSession, d: str) -> DataFrame:
    """R2 + G6: exact group medians pivoted by Progressive, every arm and visit."""
    return round_doubles(foldchange.pivot_group_median(
        fx.visits_long(spark, d), by=["Treatment", "Visit"]))


def _fcv_sql():
    med = ("SELECT metabolite, Visit, median(level) AS _med FROM src "
           f"WHERE Visit IN ({', '.join(repr(v) for v in VISITS)}) GROUP BY metabolite, Visit")
    wide = ("SELECT metabolite, " + ", ".join(
        f"max(CASE WHEN Visit = '{v}' THEN _med END) AS m_{v}" for v in VISITS)
        + f" FROM ({med}) m GROUP BY metabolite")
    rows = " UNION ALL ".join(
        f"SELECT metabolite, '{tp}' AS time_point, m_{BASELINE} AS baseline_median, "
        f"m_{tp} AS visit_median FROM fvw" for tp in FOLLOWUPS)
    return {"src": _sql_visits_clean(TREATED), "fvw": wide,
            "fv": f"SELECT *, {sk.fc_cols('visit_median', 'baseline_median')} FROM ({rows}) u"}


@register("fold_change_visits", fx.with_views(
    "SELECT metabolite, time_point, round(baseline_median, 6) AS baseline_median, "
    "round(visit_median, 6) AS visit_median, round(fold_change, 6) AS fold_change, "
    "round(log2_fold_change, 6) AS log2_fold_change FROM fv",
    "visits_long", extra=_fcv_sql()))
def fold_change_visits(spark: SparkSession, d: str) -> DataFrame:
    """M9 (+F3, X4, X7): median(visit) / median(Day0) per feature, treated arm."""
    return round_doubles(foldchange.fold_change_visits(
        _visits_clean(spark, d, TREATED), baseline=BASELINE, timepoints=FOLLOWUPS))


def _paired_ctes(rounded: bool):
    body = sk.ttest_finish(
        "mom", ["metabolite", "time_point"], est="m",
        se="sqrt(v / n)", dof="cast(n - 1 AS double)",
        status=(f"CASE WHEN n < 2 THEN 'not_enough_x' WHEN sqrt(v / n) <= 0 OR "
                f"sqrt(v / n) < 10 * {sk.EPS} * abs(m) THEN 'constant' ELSE 'ok' END"),
        method=ttest.PAIRED_METHOD, rounded=rounded)
    return body, {
        "wide": _sql_pivot(TREATED), "st": _sql_stack(FOLLOWUPS),
        "mom": ("SELECT metabolite, time_point, count(x - y) AS n, avg(x - y) AS m, "
                "var_samp(x - y) AS v FROM st GROUP BY metabolite, time_point")}


_pb, _pc = _paired_ctes(rounded=True)
_fv = _fcv_sql()


@register("stats_fc_outer", fx.with_views(
    "SELECT coalesce(p.metabolite, f.metabolite) AS metabolite, "
    "coalesce(p.time_point, f.time_point) AS time_point, p.estimate, p.statistic, p.p_value, "
    "p.parameter, p.conf_low, p.conf_high, p.method, p.alternative, p.status, "
    "round(f.baseline_median, 6) AS baseline_median, round(f.visit_median, 6) AS visit_median, "
    "round(f.fold_change, 6) AS fold_change, round(f.log2_fold_change, 6) AS log2_fold_change "
    "FROM pt p FULL OUTER JOIN fv f ON p.metabolite = f.metabolite AND p.time_point = f.time_point",
    "visits_long", extra={**_pc, "pt": _pb, "src": _fv["src"], "fvw": _fv["fvw"], "fv": _fv["fv"]}))
def stats_fc_outer(spark: SparkSession, d: str) -> DataFrame:
    """Paired-test statistics full-outer-joined with visit fold changes."""
    v = _visits_clean(spark, d, TREATED)
    stats = ttest.paired_t(ttest.pivot_visits(v, values=VISITS, on_duplicate="avg"), baseline=BASELINE,
                           timepoints=FOLLOWUPS)
    fc = foldchange.fold_change_visits(v, baseline=BASELINE, timepoints=FOLLOWUPS)
    return round_doubles(volcano.stats_with_fold_change(stats, fc,
                                                        keys=["metabolite", "time_point"]))


def _volcano_sql(final: str) -> str:
    fcg = sk.median_pivot_sql("src", keys=["Visit", "metabolite"], group="Progressive",
                              value="level", groups=(0, 1),
                              labels=("non_progressive", "progressive"))
    joined = ("SELECT coalesce(b.Visit, f.Visit) AS Visit, coalesce(b.metabolite, f.metabolite) "
              "AS metabolite, b.estimate, b.estimate1, b.estimate2, b.statistic, b.p_value AS P, "
              "b.parameter, b.conf_low, b.conf_high, b.method, b.alternative, b.status, b.p_bh, "
              "f.non_progressive, f.progressive, f.fold_change, f.log2_fold_change "
              "FROM bh b FULL OUTER JOIN fcx f ON b.Visit = f.Visit AND b.metabolite = f.metabolite")
    vol = ("SELECT *, cast(NULL AS VARCHAR) AS ID, coalesce(P < 0.0001, false) AS is_sig, "
           "CASE WHEN P = 0 THEN 'Infinity'::DOUBLE WHEN P > 0 THEN -log10(P) END AS log_p, "
           "false AS has_id FROM vj")
    return fx.with_views(final, "visits_long", extra={
        **_wc, "w": _wb, "bh": sk.bh_sql("w", p="p_value", by=["Visit"], order_key="metabolite"),
        "fcw": fcg, "fcx": f"SELECT *, {sk.fc_cols('progressive', 'non_progressive')} FROM fcw",
        "vj": joined, "vol": vol})


def _volcano_spark(spark, d):
    v = _visits_clean(spark, d, PLACEBO)
    stats = ttest.welch_by_group(v, by=["Visit"])
    fc = foldchange.fold_change_groups(v, by=["Visit"])
    return volcano.volcano_table(stats, fc, by=["Visit"], sig_column="P", threshold=1e-4)


_VOL_COLS = ["Visit", "metabolite", "estimate", "estimate1", "estimate2", "statistic", "P",
             "parameter", "conf_low", "conf_high", "method", "alternative", "status", "p_bh",
             "non_progressive", "progressive", "fold_change", "log2_fold_change", "ID", "is_sig",
             "log_p", "has_id"]
_ROUND_VOL = {"estimate", "estimate1", "estimate2", "statistic", "P", "parameter", "conf_low",
              "conf_high", "p_bh", "non_progressive", "progressive", "fold_change",
              "log2_fold_change", "log_p"}


@register("volcano_dataset", _volcano_sql(
    "SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in _ROUND_VOL else c for c in _VOL_COLS)
    + " FROM vol"))
def volcano_dataset(spark: SparkSession, d: str) -> DataFrame:
    """M14 + M16: Welch -> BH per visit -> full outer join with group fold
    change -> is_sig (P < 1e-4), log_p, has_id."""
    return round_doubles(_volcano_spark(spark, d).select(*_VOL_COLS))


@register("significant_count", _volcano_sql(
    "SELECT Visit, count(*) AS n_rows, count(CASE WHEN P < 0.0001 THEN 1 END) AS n_p_significant, "
    "count(CASE WHEN p_bh < 0.1 THEN 1 END) AS n_bh_significant FROM vol GROUP BY Visit"))
def significant_count(spark: SparkSession, d: str) -> DataFrame:
    """per visit, rows and counts under P < 1e-4 and p_bh < 0.1."""
    return volcano.significance_counts(_volcano_spark(spark, d), by=["Visit"])


# Volcano over every (arm, visit) contrast of the whole table in one job.
_ALL_SRC = ("SELECT metabolite, animal, replace(Visit, ' ', '') AS Visit, Treatment, Progressive, "
            "level FROM visits_long")
_ALL_MOM = ("SELECT Treatment, Visit, metabolite, "
            + sk.welch_moments("Progressive = 0", "Progressive = 1", "level")
            + ", count(CASE WHEN Progressive NOT IN (0, 1) THEN 1 END) AS nother "
            "FROM src WHERE level IS NOT NULL AND Progressive IS NOT NULL "
            "GROUP BY Treatment, Visit, metabolite")


def _volcano_all_sql(final: str) -> str:
    keys = ["Treatment", "Visit", "metabolite"]
    welch = sk.ttest_finish("mom", keys, **sk.welch_parts(nother="nother"),
                            method=ttest.WELCH_METHOD, rounded=False,
                            extra=[("m0", "estimate1"), ("m1", "estimate2")])
    fcg = sk.median_pivot_sql("src", keys=keys, group="Progressive", value="level",
                              groups=(0, 1), labels=("non_progressive", "progressive"))
    on = " AND ".join(f"b.{k} = f.{k}" for k in keys)
    joined = ("SELECT " + ", ".join(f"coalesce(b.{k}, f.{k}) AS {k}" for k in keys)
              + ", b.estimate, b.estimate1, b.estimate2, b.statistic, b.p_value AS P, "
              "b.parameter, b.conf_low, b.conf_high, b.method, b.alternative, b.status, b.p_bh, "
              "f.non_progressive, f.progressive, f.fold_change, f.log2_fold_change "
              f"FROM bh b FULL OUTER JOIN fcx f ON {on}")
    vol = ("SELECT *, cast(NULL AS VARCHAR) AS ID, coalesce(P < 0.0001, false) AS is_sig, "
           "CASE WHEN P = 0 THEN 'Infinity'::DOUBLE WHEN P > 0 THEN -log10(P) END AS log_p, "
           "false AS has_id FROM vj")
    return fx.with_views(final, "visits_long", extra={
        "src": _ALL_SRC, "mom": _ALL_MOM, "w": welch,
        "bh": sk.bh_sql("w", p="p_value", by=["Treatment", "Visit"], order_key="metabolite"),
        "fcw": fcg, "fcx": f"SELECT *, {sk.fc_cols('progressive', 'non_progressive')} FROM fcw",
        "vj": joined, "vol": vol})


@register("volcano_all_contrasts", _volcano_all_sql(
    "SELECT Treatment, " + ", ".join(f"round({c}, 6) AS {c}" if c in _ROUND_VOL else c
                                     for c in _VOL_COLS) + " FROM vol"))
def volcano_all_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """M16 fused over every (arm, visit) contrast of the whole long table:
    Welch -> BH per contrast -> full outer join with group fold change ->
    volcano flags, one job instead of one per contrast."""
    v = fx.visits_long(spark, d).withColumn("Visit", clean_visit("Visit"))
    by = ["Treatment", "Visit"]
    stats = ttest.welch_by_group(v, by=by)
    fc = foldchange.fold_change_groups(v, by=by)
    vol = volcano.volcano_table(stats, fc, by=by, sig_column="P", threshold=1e-4)
    return round_doubles(vol.select("Treatment", *_VOL_COLS))
