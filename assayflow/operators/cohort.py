"""Cohort assembly and description."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.functions.scalar import clean_id


def dedup_rows(df: DataFrame) -> DataFrame:
    """exact-row de-duplication."""
    return df.dropDuplicates()


def drop_incomplete(df: DataFrame) -> DataFrame:
    """drop rows with any missing value (NULL or NaN)."""
    return df.na.drop("any")


def outer_join_keys(left: DataFrame, right: DataFrame, left_on: Sequence[str],
                    right_on: Sequence[str]) -> DataFrame:
    """Full outer join on differently named keys, both key sets kept.
    Missing keys match each other (``<=>``), as in a pandas merge; Spark
    plans ``<=>`` keys as an ordinary hash/sort-merge equi-join."""
    cond = reduce(lambda a, b: a & b,
                  [left[a].eqNullSafe(right[b]) for a, b in zip(left_on, right_on)])
    return left.join(right, cond, "full")


def outer_join_hot_keys(left: DataFrame, right: DataFrame, left_on: Sequence[str],
                        right_on: Sequence[str]) -> DataFrame:
    """J1 for keys that hold a large part of both sides, missing ones included:
    the rows of ``outer_join_keys`` as matching rows and the unmatched rows of
    either side. Adaptive execution splits a hot key of an inner join on both
    sides, and of an anti join on its left; the right of each anti join is
    reduced to distinct keys first. A full outer join cannot be split. Costs
    two more passes over each side, so it pays where a key is hot."""
    def same(a: DataFrame, a_on: Sequence[str], b: DataFrame, b_on: Sequence[str]):
        return reduce(lambda x, y: x & y, [a[i].eqNullSafe(b[j]) for i, j in zip(a_on, b_on)])

    def unmatched(a: DataFrame, a_on: Sequence[str], b: DataFrame, b_on: Sequence[str]) -> DataFrame:
        keys = b.select(*[F.col(f"`{c}`").alias(f"_key{i}") for i, c in enumerate(b_on)]).distinct()
        return a.join(keys, same(a, a_on, keys, [f"_key{i}" for i in range(len(b_on))]), "left_anti")

    def nulls(df: DataFrame) -> list:
        return [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]

    matched = left.join(right, same(left, left_on, right, right_on), "inner")
    only_left = unmatched(left, left_on, right, right_on).select("*", *nulls(right))
    only_right = unmatched(right, right_on, left, left_on).select(*nulls(left), "*")
    return matched.union(only_left).union(only_right)


def combine_pheno_manifest(pheno: DataFrame, manifest: DataFrame, *,
                           pheno_keys: Sequence[str] = ("animal", "visit_dcf", "Treatment"),
                           manifest_keys: Sequence[str] = ("case_id", "Visit", "treatment_id"),
                           ) -> DataFrame:
    """De-duplicated phenotype rows, full-outer-joined with the manifest."""
    return outer_join_keys(dedup_rows(pheno), manifest, pheno_keys, manifest_keys)


def grand_table(assay: DataFrame, pheno_combined: DataFrame, *, sample_col: str = "sample_id",
                custom_col: str = "custom_id") -> DataFrame:
    """J2 (+X1): assay rows with a cleaned sample id, inner-joined to the
    combined phenotype on its custom id. The join strategy is left to the
    optimizer's size estimates (broadcast when the phenotype side is small)."""
    a = assay.withColumn(sample_col, clean_id(F.col(sample_col)))
    overlap = (set(a.columns) & set(pheno_combined.columns)) - {sample_col, custom_col}
    for c in overlap:  # pandas merge suffixes for shared non-key columns
        a = a.withColumnRenamed(c, f"{c}_x")
        pheno_combined = pheno_combined.withColumnRenamed(c, f"{c}_y")
    return a.join(pheno_combined, a[sample_col] == pheno_combined[custom_col], "inner")


def with_assay_data(pheno_combined: DataFrame, sample_ids: DataFrame, *,
                    custom_col: str = "custom_id", sample_col: str = "sample_id") -> DataFrame:
    """Phenotype rows whose custom id has assay data (left semi join)."""
    ids = sample_ids.select(F.col(sample_col).alias(custom_col))
    return pheno_combined.join(ids, [custom_col], "left_semi")


def visit_flags(df: DataFrame, *, case_col: str = "case_id", visit_col: str = "Visit",
                visits: Sequence[str] = ("Day 0", "Day 10", "Day 20")) -> DataFrame:
    """G1 + G2: per case, number of distinct visits and one presence flag per
    named visit. Rows with a missing case or visit are dropped first (pandas
    grouping drops missing keys). Column names: ``has_`` + visit without
    spaces, lower case."""
    per_visit = (df.filter(F.col(case_col).isNotNull() & F.col(visit_col).isNotNull())
                 .groupBy(case_col, visit_col).agg(F.count(visit_col).alias("_cnt")))
    flags = [F.bool_or(F.col(visit_col) == v).alias("has_" + v.replace(" ", "").lower())
             for v in visits]
    return per_visit.groupBy(case_col).agg(F.count(visit_col).alias("count"), *flags)


def complete_cases(flags: DataFrame, *, n_visits: int = 3) -> DataFrame:
    """Number of cases seen at every visit, as one row."""
    return flags.agg(F.count(F.when(F.col("count") == n_visits, 1)).alias("n_complete"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``select(c).distinct().count()`` for each column as one row
    (a missing value counts as one distinct value)."""
    return df.agg(*[
        (F.count_distinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0)))
        .alias(f"n_{c}")
        for c in columns])


def breakdown(df: DataFrame, keys: Sequence[str] = ("Treatment", "Progressive", "Visit"), *,
              count_col: str = "Visit") -> DataFrame:
    """Counts per key combination, rows with a missing key dropped."""
    keep = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(keep).groupBy(*keys).agg(F.count(count_col).alias("visit_count"))


def duplicated_samples(df: DataFrame, *, keys: Sequence[str] = ("case_id", "Visit")) -> DataFrame:
    """F8: (case, visit) pairs that occur more than once."""
    keep = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return (df.filter(keep).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1))
