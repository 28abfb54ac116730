"""Registered cohort queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.functions.scalar import clean_id, clean_visit, short_label
from assayflow.operators import cohort
from assayflow.operators.report import round_doubles
from assayflow.plans import fixtures as fx
from assayflow.plans.registry import register
from assayflow.sources.readers import read_source

RAW_VISITS = ("Day 0", "Day 10", "Day 20")

# Progressive is NULL on manifest-only rows; it is exchanged as a double so
# that both engines hand over the same representation of a nullable number.
_PC = ("SELECT p.animal, p.visit_dcf, p.Treatment, cast(p.Progressive AS DOUBLE) AS Progressive, "
       "m.case_id, m.Visit, m.treatment_id, m.custom_id "
       "FROM (SELECT DISTINCT * FROM pheno) p FULL OUTER JOIN manifest m "
       "ON p.animal IS NOT DISTINCT FROM m.case_id AND p.visit_dcf IS NOT DISTINCT FROM m.Visit "
       "AND p.Treatment IS NOT DISTINCT FROM m.treatment_id")
_IDS = "SELECT DISTINCT replace(trim(cast(sample_id AS VARCHAR)), ' ', '') AS sample_id FROM grand_wide"
_SWM = "SELECT * FROM pc WHERE custom_id IN (SELECT sample_id FROM ids)"


def _csql(body: str, *views: str, **extra: str) -> str:
    return fx.with_views(body, *(views or ("pheno", "manifest")), extra={"pc": _PC, **extra})


def _pc(spark, d):
    pc = cohort.combine_pheno_manifest(fx.pheno(spark, d), fx.manifest(spark, d))
    return pc.withColumn("Progressive", F.col("Progressive").cast("double"))


def _swm(spark, d):
    ids = fx.grand_wide(spark, d).select(clean_id(F.col("sample_id")).alias("sample_id"))
    return cohort.with_assay_data(_pc(spark, d), ids)


@register("dedup_rows", fx.with_views("SELECT DISTINCT * FROM pheno", "pheno"))
def dedup_rows(spark: SparkSession, d: str) -> DataFrame:
    """exact duplicate phenotype rows removed."""
    return cohort.dedup_rows(fx.pheno(spark, d))


@register("pheno_manifest_outer", _csql("SELECT * FROM pc"))
def pheno_manifest_outer(spark: SparkSession, d: str) -> DataFrame:
    """J1 (D1): null-safe full outer join on three differently named keys."""
    return _pc(spark, d)


@register("pheno_manifest_outer_hot_keys", _csql("SELECT * FROM pc"))
def pheno_manifest_outer_hot_keys(spark: SparkSession, d: str) -> DataFrame:
    """J1 as a matching and two unmatched parts, for hot keys."""
    return cohort.outer_join_hot_keys(cohort.dedup_rows(fx.pheno(spark, d)), fx.manifest(spark, d),
                                      ["animal", "visit_dcf", "Treatment"], ["case_id", "Visit", "treatment_id"])


@register("grand_table_inner", _csql(
    "SELECT replace(trim(cast(g.sample_id AS VARCHAR)), ' ', '') AS sample_id, g.animal AS animal_x, "
    "round(g.serum_click, 6) AS serum_click, round(g.serum_view, 6) AS serum_view, "
    "round(g.serum_signup, 6) AS serum_signup, round(g.serum_purchase, 6) AS serum_purchase, round(g.serum_error, 6) AS serum_error, "
    "g.serum_empty, pc.animal AS animal_y, pc.visit_dcf, pc.Treatment, pc.Progressive, pc.case_id, "
    "pc.Visit, pc.treatment_id, pc.custom_id "
    "FROM grand_wide g JOIN pc ON replace(trim(cast(g.sample_id AS VARCHAR)), ' ', '') = pc.custom_id",
    "pheno", "manifest", "grand_wide"))
def grand_table_inner(spark: SparkSession, d: str) -> DataFrame:
    """J2 + X1 (D2): cleaned assay sample id inner-joined to the cohort."""
    return round_doubles(cohort.grand_table(fx.grand_wide(spark, d), _pc(spark, d)))


@register("samples_with_assay", _csql("SELECT * FROM swm", "pheno", "manifest", "grand_wide",
                                      ids=_IDS, swm=_SWM))
def samples_with_assay(spark: SparkSession, d: str) -> DataFrame:
    """Cohort rows whose custom id has assay data."""
    return _swm(spark, d)


_FLAGS = ("SELECT case_id, count(Visit) AS count, "
          + ", ".join(f"bool_or(Visit = '{v}') AS has_{v.replace(' ', '').lower()}" for v in RAW_VISITS)
          + " FROM (SELECT case_id, Visit, count(Visit) AS c FROM swm WHERE case_id IS NOT NULL "
          "AND Visit IS NOT NULL GROUP BY case_id, Visit) q GROUP BY case_id")


@register("visit_flags", _csql("SELECT * FROM fl", "pheno", "manifest", "grand_wide",
                               ids=_IDS, swm=_SWM, fl=_FLAGS))
def visit_flags(spark: SparkSession, d: str) -> DataFrame:
    """G1 + G2 (D10): visits per case and presence flags per visit."""
    return cohort.visit_flags(_swm(spark, d), visits=RAW_VISITS)


@register("complete_cases", _csql("SELECT count(CASE WHEN count = 3 THEN 1 END) AS n_complete FROM fl",
                                  "pheno", "manifest", "grand_wide", ids=_IDS, swm=_SWM, fl=_FLAGS))
def complete_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases seen at all three visits."""
    return cohort.complete_cases(cohort.visit_flags(_swm(spark, d), visits=RAW_VISITS))


@register("distinct_subjects", fx.with_views(
    "SELECT count(DISTINCT subject_id) + coalesce(max(CASE WHEN subject_id IS NULL THEN 1 ELSE 0 END), 0) "
    "AS n_subject_id, count(DISTINCT site) + coalesce(max(CASE WHEN site IS NULL THEN 1 ELSE 0 END), 0) "
    "AS n_site FROM assay_long", "assay_long"))
def distinct_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Distinct subjects and sites of the regression table."""
    return cohort.distinct_counts(fx.assay_long(spark, d), ["subject_id", "site"])


@register("cohort_breakdown", _csql(
    "SELECT Treatment, Progressive, Visit, count(Visit) AS visit_count FROM swm WHERE Treatment IS "
    "NOT NULL AND Progressive IS NOT NULL AND Visit IS NOT NULL GROUP BY Treatment, Progressive, Visit",
    "pheno", "manifest", "grand_wide", ids=_IDS, swm=_SWM))
def cohort_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Counts by treatment, progression and visit."""
    return cohort.breakdown(_swm(spark, d))


@register("duplicate_samples", _csql(
    "SELECT case_id, Visit, count(*) AS n_rows FROM pc WHERE case_id IS NOT NULL AND Visit IS NOT NULL "
    "GROUP BY case_id, Visit HAVING count(*) > 1"))
def duplicate_samples(spark: SparkSession, d: str) -> DataFrame:
    """F8: (case, visit) pairs with more than one sample."""
    return cohort.duplicated_samples(_pc(spark, d))


@register("drop_any_null", _csql(
    "SELECT * FROM pc WHERE animal IS NOT NULL AND visit_dcf IS NOT NULL AND Treatment IS NOT NULL "
    "AND Progressive IS NOT NULL AND case_id IS NOT NULL AND Visit IS NOT NULL "
    "AND treatment_id IS NOT NULL AND custom_id IS NOT NULL"))
def drop_any_null(spark: SparkSession, d: str) -> DataFrame:
    """cohort rows without any missing value."""
    return cohort.drop_incomplete(_pc(spark, d))


@register("clean_visit", fx.with_views(
    "SELECT metabolite, animal, replace(Visit, ' ', '') AS Visit, Treatment, Progressive, "
    "round(level, 6) AS level FROM visits_long", "visits_long"))
def clean_visit_q(spark: SparkSession, d: str) -> DataFrame:
    """Visit labels without spaces over the whole long table."""
    v = fx.visits_long(spark, d)
    return round_doubles(v.withColumn("Visit", clean_visit("Visit")))


@register("feature_label_short", fx.with_views(
    "SELECT metabolite, split_part(metabolite, ';', 1) AS label, count(*) AS n_rows "
    "FROM visits_long GROUP BY metabolite", "visits_long"))
def feature_label_short(spark: SparkSession, d: str) -> DataFrame:
    """Display label = text before the first ';'."""
    return (fx.visits_long(spark, d).groupBy("metabolite")
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("label", short_label("metabolite")))


@register("source_lineage", "SELECT 'events.parquet' AS Source, count(*) AS n_rows FROM events")
def source_lineage(spark: SparkSession, d: str) -> DataFrame:
    """A3 (+X9): glob read with the base file name as lineage column."""
    df = read_source(spark, f"{d}/event?.parquet", "parquet")
    return df.groupBy("Source").agg(F.count(F.lit(1)).alias("n_rows"))
