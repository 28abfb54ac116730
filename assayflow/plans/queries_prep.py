"""Registered preprocessing (Z1-Z9, R1, R4, P3, P5, G7, G13, G15) and
outlier / LOD (M10-M13) queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.operators import lod, preprocess
from assayflow.operators.report import round_doubles
from assayflow.plans import fixtures as fx
from assayflow.plans.registry import register

FEATURES = ("serum_click", "serum_view", "serum_signup", "serum_purchase", "serum_error", "serum_empty")
DROP_THRESHOLD = 0.9
SEED = 10
STEPS = ("replace_zero", "drop_na", "fill_na", "log", "scale")


def _melted(spark: SparkSession, d: str) -> DataFrame:
    gw = fx.grand_wide(spark, d)
    cols = preprocess.feature_columns(gw, match="serum")
    return preprocess.melt(gw, value_cols=cols, id_cols=["sample_id", "animal"])


_GL = " UNION ALL ".join(
    f"SELECT sample_id, animal, '{f}' AS metabolite, cast({f} AS double) AS level FROM grand_wide"
    for f in FEATURES)


def _sql(body: str, **extra: str) -> str:
    return fx.with_views(body, "grand_wide", extra={"gl": _GL, **extra})


_OUT = "SELECT sample_id, animal, metabolite, round(level, 6) AS level FROM "


@register("melt_wide", _sql(_OUT + "gl"))
def melt_wide(spark: SparkSession, d: str) -> DataFrame:
    """R1 + P3: features chosen by substring, wide -> long with NULLs kept."""
    return round_doubles(_melted(spark, d))


_Z1 = "SELECT sample_id, animal, metabolite, CASE WHEN level <> 0 THEN level END AS level FROM gl"


@register("zero_to_missing", _sql(_OUT + "z1", z1=_Z1))
def zero_to_missing(spark: SparkSession, d: str) -> DataFrame:
    """Zero -> missing."""
    return round_doubles(preprocess.replace_zero(_melted(spark, d)))


def _sql_drop_na(src: str) -> str:
    return (f"SELECT * FROM {src} WHERE metabolite IN (SELECT metabolite FROM {src} GROUP BY "
            f"metabolite HAVING avg(CASE WHEN level IS NULL THEN 1.0 ELSE 0.0 END) < {DROP_THRESHOLD})")


@register("drop_by_missing_rate", _sql(_OUT + "z2", z2=_sql_drop_na("gl")))
def drop_by_missing_rate(spark: SparkSession, d: str) -> DataFrame:
    """Z2 + G7: keep features with a missing rate below 0.9."""
    return round_doubles(preprocess.drop_missing(_melted(spark, d), threshold=DROP_THRESHOLD))


def _sql_drop_empty(src: str) -> str:
    return (f"SELECT * FROM {src} WHERE metabolite IN (SELECT metabolite FROM {src} "
            f"GROUP BY metabolite HAVING count(level) > 0)")


def _sql_impute(src: str, strategy: str) -> str:
    if strategy == "zero":
        return f"SELECT sample_id, animal, metabolite, coalesce(level, 0.0) AS level FROM {src}"
    mins = f"(SELECT metabolite, min(level) AS _min FROM {src} GROUP BY metabolite)"
    if strategy == "min":
        fill = "m._min"
    else:
        u = (f"(('0x' || substr(md5(concat_ws('|', s.metabolite, s.sample_id, '{SEED}')), 1, 13))"
             f"::BIGINT / pow(2, 52))")
        fill = f"(m._min / 10 + {u} * (m._min - m._min / 10))"
    return (f"SELECT s.sample_id, s.animal, s.metabolite, coalesce(s.level, {fill}) AS level "
            f"FROM {src} s LEFT JOIN {mins} m ON s.metabolite = m.metabolite")


@register("impute_min", _sql(_OUT + "e", f=_sql_impute("gl", "min"), e=_sql_drop_empty("f")))
def impute_min(spark: SparkSession, d: str) -> DataFrame:
    """Z3 (+G8): missing -> feature minimum; still-empty features dropped."""
    return round_doubles(preprocess.impute(_melted(spark, d), strategy="min"))


@register("impute_zero", _sql(_OUT + "e", f=_sql_impute("gl", "zero"), e=_sql_drop_empty("f")))
def impute_zero(spark: SparkSession, d: str) -> DataFrame:
    """Missing -> 0."""
    return round_doubles(preprocess.impute(_melted(spark, d), strategy="zero"))


@register("impute_uniform", _sql(_OUT + "e", f=_sql_impute("gl", "uniform"),
                                 e=_sql_drop_empty("f")))
def impute_uniform(spark: SparkSession, d: str) -> DataFrame:
    """Missing -> uniform in [min/10, min) from md5(feature|sample|seed)."""
    return round_doubles(preprocess.impute(_melted(spark, d), strategy="uniform", seed=SEED))


@register("drop_empty", _sql(_OUT + "e", e=_sql_drop_empty("gl")))
def drop_empty(spark: SparkSession, d: str) -> DataFrame:
    """Z6 + G13: drop all-missing features."""
    return round_doubles(preprocess.drop_empty(_melted(spark, d)))


def _sql_log(src: str) -> str:
    return (f"SELECT sample_id, animal, metabolite, CASE WHEN level = 0 THEN {math.log(1e-200)!r} "
            f"WHEN level > 0 THEN ln(level) END AS level FROM {src}")


@register("log_transform", _sql(_OUT + "z7", z7=_sql_log("gl")))
def log_transform(spark: SparkSession, d: str) -> DataFrame:
    """Z7 (+X5): ln with 0 -> 1e-200; negatives -> NULL."""
    return round_doubles(preprocess.log_transform(_melted(spark, d)))


def _sql_scale(src: str) -> str:
    return (f"SELECT s.sample_id, s.animal, s.metabolite, (s.level - m._mu) / CASE WHEN m._sd = 0 "
            f"THEN 1.0 ELSE m._sd END AS level FROM {src} s JOIN (SELECT metabolite, avg(level) AS _mu, "
            f"stddev_pop(level) AS _sd FROM {src} GROUP BY metabolite) m ON s.metabolite = m.metabolite")


@register("standardize", _sql(_OUT + "z8", z8=_sql_scale("gl")))
def standardize(spark: SparkSession, d: str) -> DataFrame:
    """Z8 (+G9, J6): per-feature z-score, population sd."""
    return round_doubles(preprocess.standardize(_melted(spark, d)))


@register("preprocess_steps", _sql(
    _OUT + "s5", s1=_Z1.replace("FROM gl", "FROM gl"), s2=_sql_drop_na("s1"),
    s3f=_sql_impute("s2", "uniform"), s3=_sql_drop_empty("s3f"), s4=_sql_log("s3"),
    s5=_sql_scale("s4")))
def preprocess_steps(spark: SparkSession, d: str) -> DataFrame:
    """replace_zero -> drop_na(0.9) -> fill_na(uniform) -> log -> scale."""
    return round_doubles(preprocess.run_steps(
        _melted(spark, d), STEPS, impute_strategy="uniform", dropping_thres=DROP_THRESHOLD,
        seed=SEED))


@register("missing_report", _sql(
    "SELECT count(*) AS n_features, count(CASE WHEN r >= 0.9 THEN 1 END) AS n_dropped, "
    "count(CASE WHEN r = 1.0 THEN 1 END) AS n_empty, "
    "round(100.0 * count(CASE WHEN r >= 0.9 THEN 1 END) / count(*), 1) AS pct_dropped, "
    "0.9 AS threshold FROM (SELECT metabolite, avg(CASE WHEN level IS NULL THEN 1.0 ELSE 0.0 END) "
    "AS r FROM gl GROUP BY metabolite) q"))
def missing_report(spark: SparkSession, d: str) -> DataFrame:
    """Dropped-feature count and percentage."""
    return preprocess.missing_report(_melted(spark, d), threshold=DROP_THRESHOLD)


@register("transpose_assay", fx.with_views(
    "SELECT sample_id, metabolite, round(level, 6) AS level FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS sample_id, 'serum_' || targetName AS metabolite, {c} AS level "
        f"FROM targets_wide" for c in fx.DAY_COLUMNS) + ") t", "targets_wide"))
def transpose_assay(spark: SparkSession, d: str) -> DataFrame:
    """R4 + P5: targets-in-rows assay -> long (sample, serum_<target>, level)."""
    return round_doubles(preprocess.transpose_assay(fx.targets_wide(spark, d)))


# --- outliers and LOD ------------------------------------------------------

def _blanks(spark, d):
    return (fx.targets_long(spark, d).filter(F.col("is_blank"))
            .select("target", "sample_pos", "sample", "level"))


def _samples(spark, d):
    return (fx.targets_long(spark, d).filter(~F.col("is_blank"))
            .select("target", "sample_pos", "sample", "level"))


_LOD_CTES = {
    "b": "SELECT target, sample_pos, sample, level FROM targets_long WHERE is_blank",
    "s1": "SELECT target, median(level) AS med, bool_or(level IS NULL) AS poison FROM b GROUP BY target",
    "dv": "SELECT b.*, s1.med, s1.poison, abs(b.level - s1.med) AS dev FROM b JOIN s1 ON b.target = s1.target",
    "s2": "SELECT target, median(dev) AS mad FROM dv GROUP BY target",
    "z": ("SELECT dv.target, dv.sample_pos, dv.sample, dv.level, CASE WHEN NOT dv.poison THEN "
          "abs(0.6745 * (dv.level - dv.med) / (s2.mad + 1e-200)) END AS score "
          "FROM dv LEFT JOIN s2 ON dv.target = s2.target"),
    "rk": ("SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, sample_pos) AS rn, "
           "max(score) OVER (PARTITION BY target) AS ms FROM z WHERE score IS NOT NULL "
           "UNION ALL SELECT *, NULL, NULL FROM z WHERE score IS NULL"),
    "mk": ("SELECT target, sample_pos, sample, CASE WHEN rn = 1 AND ms > 2.0 THEN NULL ELSE level END "
           "AS level, score FROM rk"),
    "lodt": "SELECT target, avg(level) + 3.0 * stddev_pop(level) AS LOD FROM mk GROUP BY target",
}


def _lod_sql(body: str, **extra: str) -> str:
    return fx.with_views(body, "targets_long", extra={**_LOD_CTES, **extra})


@register("modified_z", _lod_sql(
    "SELECT target, sample_pos, sample, round(level, 6) AS level, round(score, 6) AS score FROM z"))
def modified_z(spark: SparkSession, d: str) -> DataFrame:
    """M10 (+G10, G11): modified z-scores of the blank samples per target."""
    return round_doubles(lod.modified_z(_blanks(spark, d)))


@register("mask_outliers", _lod_sql(
    "SELECT target, sample_pos, sample, round(level, 6) AS level, round(score, 6) AS score FROM mk"))
def mask_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Highest-scoring blank per target masked when its score > 2."""
    return round_doubles(lod.mask_outliers(_blanks(spark, d)))


@register("lod", _lod_sql("SELECT target, round(LOD, 6) AS LOD FROM lodt"))
def lod_table(spark: SparkSession, d: str) -> DataFrame:
    """M12 (+G12): LOD = mean + 3 sd of the masked blanks."""
    return round_doubles(lod.lod(_blanks(spark, d)))


def _correct_sql(replace: bool) -> str:
    other = "j.LOD" if replace else "NULL"
    exempt = ", ".join(f"'{t}'" for t in lod.EXEMPT_TARGETS)
    return _lod_sql(
        f"SELECT target, sample_pos, sample, round(CASE WHEN target IN ({exempt}) THEN level "
        f"WHEN below THEN {other} ELSE level END, 6) AS level FROM j "
        "WHERE target IN (SELECT target FROM j GROUP BY target HAVING NOT (bool_and(below) OR bool_and(zero)))",
        sm="SELECT target, sample_pos, sample, level FROM targets_long WHERE NOT is_blank",
        j=("SELECT sm.*, l.LOD, coalesce(sm.level < l.LOD, false) AS below, "
           "coalesce(sm.level = 0, false) AS zero FROM sm LEFT JOIN lodt l ON sm.target = l.target"))


@register("lod_correct_replace", _correct_sql(True))
def lod_correct_replace(spark: SparkSession, d: str) -> DataFrame:
    """M13 (+J5, F6): values below LOD -> LOD; all-below / all-zero targets dropped."""
    return round_doubles(lod.lod_correct(_samples(spark, d), lod.lod(_blanks(spark, d)),
                                         strategy="replace_with_LOD"))


@register("lod_correct_missing", _correct_sql(False))
def lod_correct_missing(spark: SparkSession, d: str) -> DataFrame:
    """Values below LOD -> missing."""
    return round_doubles(lod.lod_correct(_samples(spark, d), lod.lod(_blanks(spark, d)),
                                         strategy="set_missing"))
