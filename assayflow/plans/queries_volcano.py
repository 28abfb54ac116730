"""Volcano families over every arm, on a table with a planted effect, so that
significant features, their counts and their classes occur."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.functions import clean_visit
from assayflow.operators import foldchange, multiple, ttest, volcano
from assayflow.operators.report import round_doubles
from assayflow.plans import fixtures as fx
from assayflow.plans import sqlkit as sk
from assayflow.plans.queries import BASELINE, FOLLOWUPS, VISITS
from assayflow.plans.registry import register

HIGHLIGHT = ("serum_click;cl", "serum_error;er")
CUTOFF = 1e-3
_BY_GROUP, _BY_VISIT = ["Treatment", "Visit"], ["Treatment", "time_point"]
_ROUNDED = {"estimate", "estimate1", "estimate2", "statistic", "P", "parameter", "conf_low", "conf_high", "p_bh",
            "baseline_median", "visit_median", "non_progressive", "progressive", "fold_change",
            "log2_fold_change", "log_p"}

_SRC = ("SELECT metabolite, animal, replace(Visit, ' ', '') AS Visit, Treatment, Progressive, level "
        "FROM visits_planted")


def _volcano_sql(by: list[str], tests: dict[str, str], body: str, fold: dict[str, str], fold_columns: list[str],
                 final: str, extra_columns: tuple[str, ...] = (), sig: str = "P < 0.0001") -> str:
    """Tests -> BH per contrast -> full outer join with fold changes -> flags."""
    keys = [*by, "metabolite"]
    own = ["estimate", *extra_columns, "statistic", "p_value AS P", "parameter", "conf_low", "conf_high", "method",
           "alternative", "status", "p_bh"]
    joined = ("SELECT " + ", ".join(f"coalesce(b.{k}, f.{k}) AS {k}" for k in keys)
              + ", " + ", ".join(f"b.{c}" for c in own) + ", " + ", ".join(f"f.{c}" for c in fold_columns)
              + " FROM bh b FULL OUTER JOIN fcx f ON " + " AND ".join(f"b.{k} = f.{k}" for k in keys))
    vol = ("SELECT *, cast(NULL AS VARCHAR) AS ID, coalesce(" + sig + ", false) AS is_sig, "
           "CASE WHEN P = 0 THEN 'Infinity'::DOUBLE WHEN P > 0 THEN -log10(P) END AS log_p, false AS has_id FROM vj")
    return fx.with_views(final, "visits_long", "visits_planted", extra={
        "src": _SRC, **tests, "w": body, "bh": sk.bh_sql("w", p="p_value", by=by, order_key="metabolite"),
        **fold, "vj": joined, "vol": vol})


def _columns(by: list[str], fold_columns: list[str], extra_columns: tuple[str, ...] = ()) -> list[str]:
    return [*by, "metabolite", "estimate", *extra_columns, "statistic", "P", "parameter", "conf_low", "conf_high",
            "method", "alternative", "status", "p_bh", *fold_columns, "ID", "is_sig", "log_p", "has_id"]


def _select(columns: list[str]) -> str:
    return "SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in _ROUNDED else c for c in columns) + " FROM vol"


# --- visits: paired and unpaired -------------------------------------------
_PIVOT = ("SELECT Treatment, metabolite, animal, " + ", ".join(
    f"CASE WHEN count(CASE WHEN Visit = '{v}' THEN 1 END) = 0 THEN 0.0 "
    f"ELSE avg(CASE WHEN Visit = '{v}' THEN level END) END AS {v}" for v in VISITS)
    + " FROM src GROUP BY Treatment, metabolite, animal")
_STACK = " UNION ALL ".join(
    f"SELECT Treatment, metabolite, '{tp}' AS time_point, {BASELINE} AS x, {tp} AS y FROM wide" for tp in FOLLOWUPS)
_VISIT_FOLD_COLUMNS = ["baseline_median", "visit_median", "fold_change", "log2_fold_change"]
_VISIT_FOLD = {
    "med": "SELECT Treatment, metabolite, Visit, median(level) AS m FROM src GROUP BY Treatment, metabolite, Visit",
    "mw": ("SELECT Treatment, metabolite, " + ", ".join(
        f"max(CASE WHEN Visit = '{v}' THEN m END) AS m_{v}" for v in VISITS)
        + " FROM med GROUP BY Treatment, metabolite"),
    "mr": " UNION ALL ".join(
        f"SELECT Treatment, metabolite, '{tp}' AS time_point, m_{BASELINE} AS baseline_median, m_{tp} AS visit_median "
        "FROM mw" for tp in FOLLOWUPS),
    "fcx": f"SELECT *, {sk.fc_cols('visit_median', 'baseline_median')} FROM mr",
}
_KEYS = ["Treatment", "metabolite", "time_point"]
_PAIRED = sk.ttest_finish(
    "mom", _KEYS, est="m", se="sqrt(v / n)", dof="cast(n - 1 AS double)",
    status=(f"CASE WHEN n < 2 THEN 'not_enough_x' WHEN sqrt(v / n) <= 0 OR "
            f"sqrt(v / n) < 10 * {sk.EPS} * abs(m) THEN 'constant' ELSE 'ok' END"),
    method=ttest.PAIRED_METHOD, rounded=False)
_UNPAIRED = sk.ttest_finish("mom", _KEYS, **sk.welch_parts(), method=ttest.WELCH_METHOD, rounded=False)
_PAIRED_MOM = ("SELECT Treatment, metabolite, time_point, count(x - y) AS n, avg(x - y) AS m, var_samp(x - y) AS v "
               "FROM st GROUP BY Treatment, metabolite, time_point")
_UNPAIRED_MOM = ("SELECT Treatment, metabolite, time_point, count(x) AS n0, avg(x) AS m0, var_samp(x) AS v0, "
                 "count(y) AS n1, avg(y) AS m1, var_samp(y) AS v1 FROM st GROUP BY Treatment, metabolite, time_point")


def _visit_sql(body: str, moments: str) -> str:
    return _volcano_sql(_BY_VISIT, {"wide": _PIVOT, "st": _STACK, "mom": moments}, body, _VISIT_FOLD,
                        _VISIT_FOLD_COLUMNS, _select(_columns(_BY_VISIT, _VISIT_FOLD_COLUMNS)))


def _planted(spark: SparkSession, d: str) -> DataFrame:
    return fx.visits_planted(spark, d).withColumn("Visit", clean_visit("Visit"))


def _visit_volcano(spark: SparkSession, d: str, test) -> DataFrame:
    v = _planted(spark, d)
    wide = ttest.pivot_visits(v, id_cols=("Treatment", "metabolite", "animal"), values=VISITS, on_duplicate="avg")
    stats = test(wide, baseline=BASELINE, timepoints=FOLLOWUPS, by=["Treatment"])
    fc = foldchange.fold_change_visits(v, baseline=BASELINE, timepoints=FOLLOWUPS, by=["Treatment"])
    vol = volcano.volcano_table(stats, fc, by=_BY_VISIT)
    return round_doubles(vol.select(*_columns(_BY_VISIT, _VISIT_FOLD_COLUMNS)))


@register("volcano_paired", _visit_sql(_PAIRED, _PAIRED_MOM))
def volcano_paired(spark: SparkSession, d: str) -> DataFrame:
    """M16 for M4: paired t per arm and later visit, BH, visit fold change."""
    return _visit_volcano(spark, d, ttest.paired_t)


@register("volcano_unpaired", _visit_sql(_UNPAIRED, _UNPAIRED_MOM))
def volcano_unpaired(spark: SparkSession, d: str) -> DataFrame:
    """M16 for M5: Welch t of two visits per arm, BH, visit fold change."""
    return _visit_volcano(spark, d, ttest.unpaired_t)


# --- groups: Welch, raw and adjusted thresholds, cut-offs ---------------------
_GROUP_FOLD_COLUMNS = ["non_progressive", "progressive", "fold_change", "log2_fold_change"]
_GROUP_KEYS = ["Treatment", "Visit", "metabolite"]
_WELCH_MOM = ("SELECT Treatment, Visit, metabolite, "
              + sk.welch_moments("Progressive = 0", "Progressive = 1", "level")
              + ", count(CASE WHEN Progressive NOT IN (0, 1) THEN 1 END) AS nother "
              "FROM src WHERE level IS NOT NULL AND Progressive IS NOT NULL GROUP BY Treatment, Visit, metabolite")
_WELCH = sk.ttest_finish("mom", _GROUP_KEYS, **sk.welch_parts(nother="nother"), method=ttest.WELCH_METHOD,
                         rounded=False, extra=[("m0", "estimate1"), ("m1", "estimate2")])
_GROUP_FOLD = {
    "fcw": sk.median_pivot_sql("src", keys=_GROUP_KEYS, group="Progressive", value="level", groups=(0, 1),
                               labels=("non_progressive", "progressive")),
    "fcx": f"SELECT *, {sk.fc_cols('progressive', 'non_progressive')} FROM fcw",
}


def _group_sql(final: str, sig: str = "P < 0.0001") -> str:
    return _volcano_sql(_BY_GROUP, {"mom": _WELCH_MOM}, _WELCH, _GROUP_FOLD, _GROUP_FOLD_COLUMNS, final,
                        ("estimate1", "estimate2"), sig)


def _group_volcano(spark: SparkSession, d: str, **flags) -> DataFrame:
    v = _planted(spark, d)
    return volcano.volcano_table(ttest.welch_by_group(v, by=_BY_GROUP),
                                 foldchange.fold_change_groups(v, by=_BY_GROUP), by=_BY_GROUP, **flags)


_GROUP_COLUMNS = _columns(_BY_GROUP, _GROUP_FOLD_COLUMNS, ("estimate1", "estimate2"))


@register("volcano_planted", _group_sql(_select(_GROUP_COLUMNS)))
def volcano_planted(spark: SparkSession, d: str) -> DataFrame:
    """M14/M16 where is_sig occurs: Welch on the planted effect, P < 1e-4."""
    return round_doubles(_group_volcano(spark, d).select(*_GROUP_COLUMNS))


@register("volcano_p_bh", _group_sql(_select(_GROUP_COLUMNS), sig="p_bh < 0.1"))
def volcano_p_bh(spark: SparkSession, d: str) -> DataFrame:
    """M14/M16 with the adjusted threshold: significant at p_bh < 0.1."""
    return round_doubles(_group_volcano(spark, d, sig_column="p_bh", threshold=0.1).select(*_GROUP_COLUMNS))


@register("significant_count_planted", _group_sql(
    "SELECT Treatment, Visit, count(*) AS n_rows, count(CASE WHEN P < 0.0001 THEN 1 END) AS n_p_significant, "
    "count(CASE WHEN p_bh < 0.1 THEN 1 END) AS n_bh_significant FROM vol GROUP BY Treatment, Visit"))
def significant_count_planted(spark: SparkSession, d: str) -> DataFrame:
    """F7 where counts are not zero, for every arm and visit."""
    return volcano.significance_counts(_group_volcano(spark, d), by=_BY_GROUP)


_MARKED = ", ".join(f"'{h}'" for h in HIGHLIGHT)


@register("fdr_threshold_explicit", _group_sql(
    f"SELECT Treatment, Visit, cast({CUTOFF} AS double) AS p_threshold, "
    f"count(DISTINCT CASE WHEN P < {CUTOFF} THEN metabolite END) AS n_significant FROM vol GROUP BY Treatment, Visit"))
def fdr_threshold_explicit(spark: SparkSession, d: str) -> DataFrame:
    """M7 with a given raw-p cut-off instead of the FDR search."""
    return multiple.fdr_threshold(_group_volcano(spark, d), p="P", by=_BY_GROUP, feature="metabolite", cutoff=CUTOFF)


@register("highlight_significant_count", _group_sql(
    f"SELECT Treatment, Visit, cast({CUTOFF} AS double) AS p_threshold, "
    f"count(DISTINCT CASE WHEN P < {CUTOFF} THEN metabolite END) AS n_significant, "
    f"count(DISTINCT CASE WHEN P < {CUTOFF} AND metabolite IN ({_MARKED}) THEN metabolite END) AS n_highlighted "
    "FROM vol GROUP BY Treatment, Visit"))
def highlight_significant_count(spark: SparkSession, d: str) -> DataFrame:
    """Significant features, and how many of them are highlighted."""
    return multiple.fdr_threshold(_group_volcano(spark, d), p="P", by=_BY_GROUP, feature="metabolite", cutoff=CUTOFF,
                                  highlight=HIGHLIGHT)


@register("feature_class_planted", _group_sql(
    f"SELECT Treatment, Visit, metabolite, CASE WHEN metabolite = '{HIGHLIGHT[1]}' THEN '{volcano.HIGHLIGHT}' "
    "WHEN coalesce(P < thr, false) THEN '" + volcano.SIGNIFICANT + "' ELSE '" + volcano.TOTAL + "' END AS \"group\" "
    "FROM (SELECT *, coalesce(min(CASE WHEN p_bh >= 0.1 THEN P END) OVER (PARTITION BY Treatment, Visit), "
    "'Infinity'::DOUBLE) AS thr FROM vol) z"))
def feature_class_planted(spark: SparkSession, d: str) -> DataFrame:
    """M15 where all three classes occur."""
    stats = ttest.welch_by_group(_planted(spark, d), by=_BY_GROUP)
    return volcano.feature_classes(stats, feature="metabolite", p="p_value", by=_BY_GROUP,
                                   highlight=HIGHLIGHT[1:]).select(*_BY_GROUP, "metabolite", "group")


# --- NaN: the same rows with some levels replaced by NaN ----------------------
_NAN_SRC = ("SELECT metabolite, animal, replace(Visit, ' ', '') AS Visit, Treatment, Progressive, "
            "CASE WHEN cast(animal AS bigint) % 7 = 0 THEN NULL ELSE level END AS level FROM visits_planted")


@register("welch_with_nan", fx.with_views(
    sk.ttest_finish("mom", _GROUP_KEYS, **sk.welch_parts(nother="nother"), method=ttest.WELCH_METHOD,
                    extra=[("m0", "estimate1"), ("m1", "estimate2")]),
    "visits_long", "visits_planted", extra={"src": _NAN_SRC, "mom": _WELCH_MOM}))
def welch_with_nan(spark: SparkSession, d: str) -> DataFrame:
    """M3 where a seventh of the animals have NaN levels: NaN is missing."""
    v = _planted(spark, d).withColumn("level", F.when(
        F.col("animal").cast("bigint") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("level")))
    return round_doubles(ttest.welch_by_group(v, by=_BY_GROUP))
