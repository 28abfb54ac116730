"""Median fold changes (M8, M9) and the group-median pivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.functions.scalar import log2_safe, ratio
from assayflow.operators.quantile import group_median


def pivot_group_median(df: DataFrame, *, feature: str = "metabolite", group: str = "Progressive",
                       value: str = "level", by: Sequence[str] = (), groups=(0, 1),
                       labels=("non_progressive", "progressive")) -> DataFrame:
    """Median of ``value`` per (by, feature, group), pivoted to one
    column per group label. Pivot values are explicit; the pivot itself runs
    over one row per (feature, group)."""
    med = group_median(df, [*by, feature, group], value, out="_med")
    return med.groupBy(*by, feature).agg(*[
        F.max(F.when(F.col(group) == F.lit(g), F.col("_med"))).alias(lbl)
        for g, lbl in zip(groups, labels)])


def fold_change_groups(df: DataFrame, *, feature: str = "metabolite", group: str = "Progressive",
                       value: str = "level", by: Sequence[str] = (), groups=(0, 1),
                       labels=("non_progressive", "progressive")) -> DataFrame:
    """M8: median(groups[1]) / median(groups[0]) and its log2 per feature.
    A zero or missing denominator gives NULL (not +-inf / NaN)."""
    wide = pivot_group_median(df, feature=feature, group=group, value=value, by=by,
                              groups=groups, labels=labels)
    fc = ratio(F.col(labels[1]), F.col(labels[0]))
    return wide.withColumn("fold_change", fc).withColumn(
        "log2_fold_change", log2_safe(F.col("fold_change")))


def fold_change_visits(df: DataFrame, *, feature: str = "metabolite", visit: str = "Visit",
                       value: str = "level", baseline: str = "Day0",
                       timepoints: Sequence[str] = ("Day10", "Day20"),
                       by: Sequence[str] = ()) -> DataFrame:
    """M9 (+F3): median(time point) / median(baseline) per feature, for every
    time point in one pass: medians per (feature, visit) are computed once and
    the baseline is paired with each later visit."""
    wanted = [baseline, *timepoints]
    med = group_median(df.filter(F.col(visit).isin(wanted)), [*by, feature, visit], value, out="_med")
    wide = med.groupBy(*by, feature).agg(*[
        F.max(F.when(F.col(visit) == v, F.col("_med"))).alias(f"_m_{v}") for v in wanted])
    rows = F.array(*[F.struct(F.lit(tp).alias("time_point"),
                              F.col(f"_m_{baseline}").alias("baseline_median"),
                              F.col(f"_m_{tp}").alias("visit_median")) for tp in timepoints])
    out = wide.select(*by, feature, F.inline(rows))
    fc = ratio(F.col("visit_median"), F.col("baseline_median"))
    return out.withColumn("fold_change", fc).withColumn(
        "log2_fold_change", log2_safe(F.col("fold_change")))
