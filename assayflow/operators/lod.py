"""Outlier scores, outlier masking and limit of detection.

Input shape: ``(target, sample_pos, sample, level)`` - one row per target and
sample; ``sample_pos`` orders samples the way columns were ordered in the
original wide files (used to break ties).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.functions.scalar import nan_to_null
from assayflow.operators.joins import join_group_stats
from assayflow.operators.quantile import group_median
from assayflow.session import written

# Fixed values of the original LOD procedure.
MODIFIED_Z_CONSTANT = 0.6745
MAD_FLOOR = 1e-200
OUTLIER_THRESHOLD = 2.0
LOD_MULTIPLIER, LOD_MULTIPLIER_SINGLEPLEX = 3.0, 2.5
EXEMPT_TARGETS = ("KNG1", "CRP")


def modified_z(df: DataFrame, *, target: str = "target", value: str = "level") -> DataFrame:
    """M10 (+G10, G11, X6): |0.6745 (x - median) / (MAD + 1e-200)| per target.

    As with numpy's median over a row, one missing level (NULL or NaN) makes
    the target's median - and every score of that target - missing. Medians
    and deviations are written tables of one row per target."""
    v = nan_to_null(F.col(value))
    med = group_median(df, [target], value, out="_med")
    poisoned = df.groupBy(target).agg(F.bool_or(v.isNull()).alias("_poison"))
    stats = written(med.join(poisoned, [target], "right"), "median")
    j = df.join(stats, [target], "left").withColumn("_dev", F.abs(v - F.col("_med")))
    mad = group_median(j, [target], "_dev", out="_mad")
    j2 = join_group_stats(j, mad, [target], "left")
    score = F.abs(MODIFIED_Z_CONSTANT * (v - F.col("_med")) / (F.col("_mad") + MAD_FLOOR))
    return (j2.withColumn("score", F.when(~F.col("_poison"), score))
            .drop("_med", "_poison", "_dev", "_mad"))


def mask_outliers(df: DataFrame, *, target: str = "target", sample_pos: str = "sample_pos",
                  value: str = "level", threshold: float = OUTLIER_THRESHOLD) -> DataFrame:
    """For every target with a score above ``threshold``, set the level
    of the single highest-scoring sample (first by position on ties) to
    missing. The arg-max is a partial aggregation of
    ``max(struct(score, -position))``, not a per-target sort."""
    scored = modified_z(df, target=target, value=value)
    top = scored.filter(F.col("score").isNotNull()).groupBy(target).agg(
        F.max(F.struct(F.col("score").alias("s"), (-F.col(sample_pos)).alias("np"))).alias("_top"))
    top = top.select(target, F.col("_top.s").alias("_max_score"),
                     (-F.col("_top.np")).alias("_max_pos"))
    j = join_group_stats(scored, top, [target], "left")
    hit = (F.col("_max_score") > threshold) & (F.col(sample_pos) == F.col("_max_pos"))
    return (j.withColumn(value, F.when(F.coalesce(hit, F.lit(False)), F.lit(None).cast("double"))
                         .otherwise(F.col(value)))
            .drop("_max_score", "_max_pos"))


def lod(df: DataFrame, *, target: str = "target", sample_pos: str = "sample_pos",
        value: str = "level", singleplex: bool = False) -> DataFrame:
    """M12 (+G12): LOD = mean + k * sd (population, missing skipped) of the
    outlier-masked levels; k = 3, or 2.5 for singleplex assays."""
    k = LOD_MULTIPLIER_SINGLEPLEX if singleplex else LOD_MULTIPLIER
    masked = mask_outliers(df, target=target, sample_pos=sample_pos, value=value)
    v = nan_to_null(F.col(value))
    return masked.groupBy(target).agg((F.avg(v) + k * F.stddev_pop(v)).alias("LOD"))


def lod_correct(df: DataFrame, lods: DataFrame, *, target: str = "target", value: str = "level",
                strategy: str = "replace_with_LOD",
                exempt: Sequence[str] = EXEMPT_TARGETS) -> DataFrame:
    """M13 (+J5, F6, G13): values below the target's LOD become the LOD
    (``replace_with_LOD``) or missing (any other strategy); exempt targets
    keep raw values. Targets whose every value is below the LOD, or every
    value is zero, are dropped - exempt or not. A target without LOD is
    never below it."""
    v = nan_to_null(F.col(value))
    j = join_group_stats(df, lods.select(target, "LOD"), [target], "left")
    below = F.coalesce(v < F.col("LOD"), F.lit(False))
    zero = F.coalesce(v == 0, F.lit(False))
    other = F.col("LOD") if strategy == "replace_with_LOD" else F.lit(None).cast("double")
    corrected = F.when(F.col(target).isin(list(exempt)), v).when(below, other).otherwise(v)
    flagged = j.withColumn("_below", below).withColumn("_zero", zero)
    # Per-target drop flag joined back and filtered (an equi-join on the key;
    # a semi join would be rewritten into an existence check for inputs that
    # are unions of constant-labelled parts).
    flags = flagged.groupBy(target).agg(
        (F.bool_and("_below") | F.bool_and("_zero")).alias("_drop"))
    kept = join_group_stats(flagged, flags, [target], "left").filter(~F.col("_drop"))
    return kept.withColumn(value, corrected).drop("LOD", "_below", "_zero", "_drop")
