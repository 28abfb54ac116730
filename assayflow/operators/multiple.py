"""Multiple-testing correction (M6) and FDR cut-off (M7).

The adjusted value of p depends only on the multiset of p-values:

    adj(p) = min(1, min over distinct values w >= p of w * m / #{p_j <= w})

so ties need no order. p-values are first reduced to distinct values with
their multiplicity (a partial aggregation: a p shared by many features
becomes one row). The distinct values are range-partitioned by (contrast, p),
as many partitions as their size asks for, and sorted; running counts and
suffix minima are windows inside one contrast and partition, joined with tiny
per-(contrast, partition) offsets and minima. No task ever holds a whole
contrast.

NULL p-values are ignored (they do not count in m) and get a NULL result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayflow.operators.joins import join_contrast_table
from assayflow.session import written


def bh_adjust(df: DataFrame, *, p: str = "p_value", by: Sequence[str] = (), out: str = "p_bh") -> DataFrame:
    """M6: Benjamini-Hochberg adjusted p per contrast ``by`` into ``out``.

    The input is a per-feature result table that is read twice (distinct
    p-values, and the rows the adjustment is joined back to). It is written
    first - one row per feature and contrast - so the model fit upstream runs
    once, not once per branch."""
    by = list(by)
    df = written(df, "tests")
    pv = F.col(p).cast("double")
    valid = df.select(*by, pv.alias("_p")).filter(F.col("_p").isNotNull() & ~F.isnan("_p"))
    distinct = valid.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"))
    keyed = df.withColumn("_pk", pv)
    return keyed.join(_adjusted(distinct, by, out), [*by, "_pk"], "left").drop("_pk")


def _adjusted(distinct: DataFrame, by: list[str], out: str) -> DataFrame:
    """(by..., _pk, out) of every distinct p."""
    order = [*by, "_p"]
    ranked = written(distinct.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()), "ranges")

    # per contrast and range: rows before it, and all rows of the contrast
    per_range = ranked.groupBy(*by, "_b").agg(F.sum("_c").alias("_bc"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *by, "_b", F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_off"),
        F.sum("_bc").over(Window.partitionBy(*by)).alias("_m"))
    inside = Window.partitionBy(*by, "_b")
    upto = F.col("_off") + F.sum("_c").over(inside.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    ranked = join_contrast_table(ranked, offsets, [*by, "_b"]).withColumn("_q", F.col("_p") * F.col("_m") / upto)

    # suffix minima: inside the range, and over the later ranges
    ranked = ranked.withColumn("_qmin", F.min("_q").over(
        inside.orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    least = ranked.groupBy(*by, "_b").agg(F.min("_q").alias("_bq"))
    after = Window.partitionBy(*by).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = least.select(*by, "_b", F.min("_bq").over(after).alias("_later"))
    return join_contrast_table(ranked, later, [*by, "_b"]).select(
        *by, F.col("_p").alias("_pk"),
        F.least(F.lit(1.0), F.col("_qmin"), F.coalesce("_later", F.lit(float("inf")))).alias(out))


def fdr_threshold(df: DataFrame, *, p: str = "p_value", adjusted: str = "p_bh",
                  by: Sequence[str] = (), fdr: float = 0.1, compat: bool = False,
                  feature: str | None = None, cutoff: float | None = None,
                  highlight: Sequence[str] = ()) -> DataFrame:
    """M7: raw-p cut-off per contrast: the smallest p whose adjusted p
    reaches ``fdr``; significant means p < threshold. ``cutoff`` names the
    raw-p threshold instead.

    When no adjusted p reaches ``fdr`` every feature is significant and the
    threshold is +inf; ``compat=True`` instead returns the smallest p (the
    original notebook's behaviour, which then flags nothing).
    With ``feature`` given, also counts distinct significant features (G14)
    and, of those, the ones in ``highlight``.
    """
    pv, adj = F.col(p), F.col(adjusted)
    fallback = F.min(pv) if compat else F.lit(float("inf"))
    threshold = F.coalesce(F.min(F.when(adj >= fdr, pv)), fallback) if cutoff is None \
        else F.first(F.lit(float(cutoff)))
    agg = df.groupBy(*by).agg(threshold.alias("p_threshold"))
    if feature is None:
        return agg
    # the cut-off table has one row per contrast; writing it keeps the tests'
    # chain out of the second branch
    counts = [F.count_distinct(F.when(pv < F.col("p_threshold"), F.col(feature))).alias("n_significant")]
    if highlight:
        counts.append(F.count_distinct(F.when((pv < F.col("p_threshold")) & F.col(feature).isin(list(highlight)),
                                              F.col(feature))).alias("n_highlighted"))
    df = written(df.select(*by, F.col(feature), pv.alias(p), adj.alias(adjusted)), "adjusted")
    agg = df.groupBy(*by).agg(threshold.alias("p_threshold"))
    return join_contrast_table(df, agg, list(by)).groupBy(*by).agg(
        F.first("p_threshold").alias("p_threshold"), *counts)
