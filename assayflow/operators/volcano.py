"""Volcano-ready result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.functions.scalar import false_if_null, neg_log10
from assayflow.operators.joins import join_contrast_table
from assayflow.operators.multiple import bh_adjust, fdr_threshold

# Fixed class labels of the original plots.
TOTAL, SIGNIFICANT, HIGHLIGHT = "total biomarkers", "significant biomarkers", "PD biomarkers"


def stats_with_fold_change(stats: DataFrame, fc: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Full outer join of test statistics and fold changes on the feature
    (and contrast) keys; keys are coalesced. Both sides have one row per
    feature, so this join is small whatever the raw data size."""
    return stats.join(fc, list(keys), "full")


def volcano_dataset(df: DataFrame, *, p: str = "p_value", sig_column: str = "P",
                    threshold: float = 1e-4) -> DataFrame:
    """Rename p -> P, add ``is_sig`` (``sig_column`` < threshold, missing =
    false), ``log_p`` = -log10(P) (+inf for P == 0) and ``has_id`` (an ``ID``
    column is present but always NULL in the original, so it is false)."""
    out = df.withColumnRenamed(p, "P")
    if "ID" not in out.columns:
        out = out.withColumn("ID", F.lit(None).cast("string"))
    is_sig = false_if_null(F.col(sig_column) < F.lit(threshold))
    return (out.withColumn("is_sig", is_sig)
            .withColumn("log_p", neg_log10(F.col("P")))
            .withColumn("has_id", F.col("ID").isNotNull() & F.col("is_sig")))


def volcano_table(stats: DataFrame, fc: DataFrame, *, feature: str = "metabolite",
                  by: Sequence[str] = (), p: str = "p_value", sig_column: str = "P",
                  threshold: float = 1e-4) -> DataFrame:
    """Tests -> BH per contrast -> full outer join with fold change ->
    volcano flags, every contrast in the same job."""
    adj = bh_adjust(stats, p=p, by=by, out="p_bh")
    joined = stats_with_fold_change(adj, fc, keys=[*by, feature])
    return volcano_dataset(joined, p=p, sig_column=sig_column, threshold=threshold)


def significance_counts(vol: DataFrame, *, by: Sequence[str] = (), p_threshold: float = 1e-4,
                        bh_threshold: float = 0.1) -> DataFrame:
    """per contrast, table size and counts below the raw-p and BH
    thresholds (the printed shapes of the original job)."""
    return vol.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("P") < p_threshold, 1)).alias("n_p_significant"),
        F.count(F.when(F.col("p_bh") < bh_threshold, 1)).alias("n_bh_significant"))


def feature_classes(results: DataFrame, *, feature: str = "feature_label", p: str = "LR_P_Value",
                    by: Sequence[str] = ("independent_variable",), fdr: float = 0.1,
                    highlight: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """M15 (+M6, M7): BH per contrast, raw-p cut-off for the FDR target, then
    the three-way class: highlighted (wins) / significant / total, with
    -log10(p) for plotting."""
    adj = bh_adjust(results, p=p, by=by, out="p_bh")
    thr = fdr_threshold(adj, p=p, adjusted="p_bh", by=by, fdr=fdr, compat=compat)
    withthr = join_contrast_table(adj, thr, list(by))
    cls = (F.when(F.col(feature).isin(list(highlight)), F.lit(HIGHLIGHT)) if highlight
           else F.when(F.lit(False), F.lit(HIGHLIGHT)))
    cls = cls.when(false_if_null(F.col(p) < F.col("p_threshold")), F.lit(SIGNIFICANT)).otherwise(
        F.lit(TOTAL))
    return withthr.withColumn("group", cls).withColumn("neg_log10_p", neg_log10(F.col(p)))
