"""Sinks (S1-S5). Results are written by the executors; nothing is
collected to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from assayflow.operators.ttest import to_tidy_names


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite",
              partition_by: Sequence[str] = (), tidy_names: bool = False) -> None:
    """S1 (+S4): CSV with header. ``partition_by`` replaces the original
    one-file-per-loop-value outputs (time point, variable) with one
    partitioned dataset; ``tidy_names`` emits ``p.value``-style names.

    Like one file per loop value, an overwrite by partitions replaces the
    partitions it has rows for and leaves all others as they are."""
    out = to_tidy_names(df) if tidy_names else df
    _partitioned(out.write.mode(mode).option("header", "true"), partition_by).csv(path)


def _partitioned(writer: DataFrameWriter, partition_by: Sequence[str]) -> DataFrameWriter:
    """Dynamic overwrite of partitions, as an option of this one write."""
    if not partition_by:
        return writer
    return writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")


def write_dataset(df: DataFrame, path: str, *, fmt: str = "parquet", mode: str = "overwrite",
                  partition_by: Sequence[str] = ()) -> None:
    """S2 (+S4): overwrite with schema replacement. ``overwriteSchema`` is
    passed for table formats that know it (ignored by plain files). With
    ``partition_by`` only the partitions that have rows are replaced, and the
    schema of the others stays."""
    w = df.write.format(fmt).mode(mode)
    if not partition_by:
        w = w.option("overwriteSchema", "true")
    _partitioned(w, partition_by).save(path)


def save_table(spark: SparkSession, df: DataFrame, table: str, path: str, *,
               fmt: str = "parquet", mode: str = "overwrite") -> None:
    """S3: create the database if absent, then save an external table at
    ``path``."""
    if "." in table:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.split('.')[0]}")
    df.write.format(fmt).mode(mode).option("path", path).saveAsTable(table)


def republish(spark: SparkSession, sources: dict[str, str], target_dir: str, *, prefix: str,
              fmt: str = "csv") -> DataFrame:
    """Re-write packaged outputs under ``<prefix><name>`` and report
    their row and column counts as a DataFrame (the sources are kept).
    Rows are counted while they are written, one job per output."""
    rows = []
    for name, src in sources.items():
        df = (spark.read.option("header", "true").csv(src) if fmt == "csv"
              else spark.read.format(fmt).load(src))
        dest = f"{target_dir.rstrip('/')}/{prefix}{name}"
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
        if fmt == "csv":
            write_csv(counted, dest)
        else:
            write_dataset(counted, dest, fmt=fmt)
        rows.append((name, dest, seen.get["n"], len(df.columns)))
    return spark.createDataFrame(rows, "name string, path string, n_rows long, n_cols int")
