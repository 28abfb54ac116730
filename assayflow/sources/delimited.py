"""Delimited files that need not agree: malformed rows and mixed headers (A1-A4).

Files are grouped by their header line and every group is read with the
columns in its own order, so files whose columns are exchanged or missing are
united by name. A row with too few or too many cells, or with a cell that is
not of its column's type, is kept with its text and its file, never lost.
"""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from assayflow.functions.scalar import last_path_segment


def header_groups(spark: SparkSession, path: str, delimiter: str = ",") -> dict[tuple[str, ...], list[str]]:
    """The distinct headers below ``path`` and the files of each. One pass
    over the text reduces every file to its first line that is not blank;
    files without one are left out. The driver holds one path per file, as
    Spark's own file index does."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    # the rows of a split are numbered in the order of the file
    first = (lines.filter(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
             .groupBy("file").agg(F.min_by("value", F.struct("start", "at")).alias("header")))
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("file").toLocalIterator():
        names = tuple(n.strip() for n in next(csv.reader([row["header"].lstrip("﻿")], delimiter=delimiter)))
        groups.setdefault(names, []).append(unquote(row["file"]))
    return groups


def read_delimited(spark: SparkSession, path: str, *, types: StructType | None = None, delimiter: str = ",",
                   lineage_column: str = "Source", record_column: str = "bad_record") -> DataFrame:
    """Every row of the files below ``path`` (a file, folder or glob), with
    the base name of its file and, where it is malformed, its text in
    ``record_column`` (else NULL).

    ``types`` gives columns their types by name; others are strings. A column
    that a file lacks is NULL there; one of ``types`` that no file has is an
    error, like a header that names a column twice. A malformed row keeps the
    cells that could be read."""
    known = {f.name: f.dataType for f in (types.fields if types is not None else [])}
    groups = header_groups(spark, path, delimiter)
    if not groups:
        raise ValueError(f"no file with a header below {path}")
    absent = set(known) - {n for names in groups for n in names}
    if absent:
        raise ValueError(f"no file has the columns {sorted(absent)}")
    parts = []
    for names, files in groups.items():
        if len(set(names)) < len(names) or {lineage_column, record_column} & set(names):
            raise ValueError(f"{files[0]}: a column name occurs twice or is reserved: {names}")
        fields = [StructField(n, known.get(n, StringType())) for n in names]
        # rows are judged by all their cells, whatever columns are asked for
        rows = (spark.read.option("columnPruning", "false").schema(StructType([*fields, StructField(record_column, StringType())]))
                .option("header", "true").option("delimiter", delimiter).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", record_column).csv(files))
        parts.append(rows.select(*[F.col(f"`{n}`") for n in names],
                                 last_path_segment(F.col("_metadata.file_path")).alias(lineage_column),
                                 _beside(F.col(record_column), F.col(f"`{names[0]}`")).alias(record_column)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _beside(record: Column, cell: Column) -> Column:
    """The record, with a data column in the scan: Spark refuses a scan of
    the records of malformed rows alone."""
    nothing = F.substring(F.coalesce(cell.cast("string"), F.lit("")), 1, 0)
    return F.when(record.isNotNull(), F.concat(record, nothing))


def good_rows(rows: DataFrame, record_column: str = "bad_record") -> DataFrame:
    """The well-formed rows of ``read_delimited``."""
    return rows.filter(F.col(record_column).isNull()).drop(record_column)


def bad_rows(rows: DataFrame, lineage_column: str = "Source", record_column: str = "bad_record") -> DataFrame:
    """File and text of the malformed rows."""
    return rows.filter(F.col(record_column).isNotNull()).select(lineage_column, record_column)


def rows_per_file(rows: DataFrame, lineage_column: str = "Source", record_column: str = "bad_record") -> DataFrame:
    """Rows and malformed rows of every file that has rows."""
    return rows.groupBy(lineage_column).agg(F.count(F.lit(1)).alias("n_rows"), F.count(record_column).alias("n_bad"))
