"""Join helpers for per-group statistics joined back onto row-level data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.session import written


def join_group_stats(rows: DataFrame, stats: DataFrame, on: Sequence[str],
                     how: str = "inner") -> DataFrame:
    """Join a per-group statistics table (one row per key) back onto rows.

    The statistics are written first, so the planner knows their size before
    it plans the row side: below ``spark.sql.autoBroadcastJoinThreshold`` they
    are broadcast and the rows never shuffle; beyond it the join stays a
    sort-merge join whose skewed partitions (a hot group) are split.
    """
    return rows.join(written(stats, "stats"), list(on), how)


def join_contrast_table(rows: DataFrame, small: DataFrame, on: Sequence[str],
                        how: str = "inner") -> DataFrame:
    """Join a table with one row per contrast (time point, variable, ...) or
    per (contrast, bucket) onto rows.

    With no contrast keys the table has exactly one row: it is broadcast on a
    constant key (a broadcast hash join, never a cross join, and never a
    shuffle of every row to one partition). With keys, its size depends on
    how many contrasts the data has, so the join is left to adaptive
    execution, which broadcasts it after measuring it (typically a handful of
    rows) and otherwise keeps a sort-merge join.
    """
    if not on:
        rows = rows.withColumn("_all", F.lit(0))
        small = small.withColumn("_all", F.lit(0))
        return rows.join(F.broadcast(small), ["_all"], how).drop("_all")
    return rows.join(small, list(on), how)
