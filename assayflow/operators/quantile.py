"""Exact group medians by distributed selection.

``median``/``percentile`` aggregates keep a map of every distinct value of a
group in one buffer, so a group holding a large share of the data would sit
whole in one task. Here the exact median is found in bounded steps:

1. one partial aggregation per group: row count and a small quantile sketch
   (``percentile_approx``, about a hundred kilobytes per group and task at
   most) bracketing the middle ranks; its rank error is at most n / accuracy;
2. while more than ``LARGEST_BRACKET`` rows may lie strictly inside a bracket,
   the rows below, at and between its ends are counted - plain partial sums -
   and a sketch of those between gives a bracket of about a twentieth of them.
   Ranks that fall on an end are decided by its count, so ties, infinities and
   constant groups end as fast as others: rounds grow with the logarithm of
   the rows;
3. one pass counts the rows below the bracket and aggregates the values
   inside it by (group, value), so a value repeated millions of times becomes
   one row; a running count over them picks ranks floor((n+1)/2) and
   ceil((n+1)/2).

The bracket tables have one row per group and are written before the rows
meet them. The result equals numpy's / pandas' median (mean of the two middle
values; NULL and NaN are skipped). The bracket is verified; a violation
(impossible under the sketch's guarantee) fails the job instead of returning
a wrong value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from assayflow.session import written

DEFAULT_ACCURACY = 1_000
LARGEST_BRACKET = 1_000_000
#: Steps of the sketch that narrows a bracket.
GRID = 100


def _bracket_table(brackets: DataFrame) -> tuple[DataFrame, int]:
    """The written brackets and the most rows that one may hold inside,
    observed while they are written."""
    seen = Observation()
    open_rows = F.when(F.col("_hi") > F.col("_lo"), F.col("_inside")).otherwise(F.lit(0))
    table = written(brackets.observe(seen, F.max(open_rows).alias("widest")), "bracket")
    return table, seen.get.get("widest") or 0


def _narrowed(base: DataFrame, brackets: DataFrame, keys: list[str], accuracy: int) -> DataFrame:
    """Brackets cut down to the neighbourhood of the middle ranks."""
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    between = (v > lo) & (v < hi)
    steps = [i / GRID for i in range(GRID + 1)]
    counts = base.join(brackets, keys).groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
        F.count(F.when(v <= lo, 1)).alias("_to_lo"), F.count(F.when(between, 1)).alias("_mid"),
        F.percentile_approx(F.when(between, v), steps, accuracy).alias("_grid"))
    first, last = F.floor((F.col("_n") + 1) / 2), F.ceil((F.col("_n") + 1) / 2)
    pad = 1 + math.ceil(GRID / accuracy)     # the sketch's rank error, in steps

    def end(rank, step):
        """The end for a rank: an old one that holds it, or a grid value."""
        inside = rank - F.col("_to_lo")
        return F.when(inside <= 0, lo).when(inside > F.col("_mid"), hi).otherwise(
            F.get("_grid", step(inside / F.col("_mid") * GRID).cast("int")))
    return counts.select(
        *keys, "_n", end(first, lambda p: F.greatest(F.floor(p) - pad, F.lit(0))).alias("_lo"),
        end(last, lambda p: F.least(F.ceil(p) + pad, F.lit(GRID))).alias("_hi"),
        F.floor(F.col("_mid") * ((2 * pad + 3) / GRID + 2 / accuracy)).alias("_inside"))


def group_median(df: DataFrame, keys: Sequence[str], value: str, *, out: str = "median",
                 accuracy: int = DEFAULT_ACCURACY, largest_bracket: int = LARGEST_BRACKET) -> DataFrame:
    """One row per group: ``keys..., out`` (exact median, NULL and NaN
    skipped; groups without a value are absent)."""
    keys = list(keys)
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    margin = 3.0 / accuracy
    brackets, widest = _bracket_table(base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)],
                            accuracy).alias("_br"),
    ).select(*keys, "_n", F.col("_br")[0].alias("_lo"), F.col("_br")[1].alias("_hi"),
             F.ceil(F.col("_n") * (2 * margin + 2.0 / accuracy)).alias("_inside")))
    while widest > largest_bracket:
        brackets, widest = _bracket_table(_narrowed(base, brackets, keys, accuracy))

    tagged = base.join(brackets.drop("_inside"), keys)
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    inside = (v >= lo) & (v <= hi)
    # One partial aggregation: a row per distinct in-bracket value, plus one
    # row (value NULL) per group carrying the count below the bracket.
    cells = tagged.groupBy(*keys, F.when(inside, v).alias("_iv")).agg(
        F.first("_n").alias("_n"),
        F.count(F.lit(1)).alias("_c"),
        F.count(F.when(v < lo, 1)).alias("_cb"),
    )
    part = Window.partitionBy(*keys)
    running = part.orderBy("_iv").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k1 = F.floor((F.col("_n") + 1) / 2)
    k2 = F.ceil((F.col("_n") + 1) / 2)
    ranked = (cells
              .withColumn("_below", F.sum("_cb").over(part))
              .withColumn("_cum", F.sum(F.when(F.col("_iv").isNotNull(), F.col("_c"))
                                        .otherwise(F.lit(0))).over(running)))
    at_or_above = lambda r: F.col("_iv").isNotNull() & (F.col("_cum") >= r - F.col("_below"))
    res = ranked.groupBy(*keys).agg(
        F.min(F.when(at_or_above(k1), F.col("_iv"))).alias("_a"),
        F.min(F.when(at_or_above(k2), F.col("_iv"))).alias("_b"),
        F.max("_below").alias("_below"), F.max("_cum").alias("_inside"), F.max("_n").alias("_n"),
    )
    # The sketch guarantees the bracket holds ranks k1..k2; fail loudly if not.
    violated = ((F.col("_below") >= F.floor((F.col("_n") + 1) / 2)) |
                (F.col("_below") + F.col("_inside") < F.ceil((F.col("_n") + 1) / 2)))
    med = F.when(violated, F.raise_error(F.lit("median bracket violated")).cast("double")) \
        .otherwise((F.col("_a") + F.col("_b")) / 2)
    return res.select(*keys, med.alias(out))
