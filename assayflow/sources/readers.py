"""Readers (A1-A8).

One entry point, ``read_source``, with an explicit format: CSV (header,
delimiter, inferred or given schema, selected columns forced to string),
parquet / ORC / JSON / any data source Spark knows, catalog tables, globs
with a lineage column and whole directories. Paths go to Spark's file
system layer unchanged, so local, HDFS and object-store URIs all work.
Unreadable input raises; nothing returns None.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from assayflow.functions.scalar import last_path_segment

# Fixed value: the characters that make a path a glob.
GLOB_CHARS = re.compile(r"[*?\[\]{}]")
# Formats whose column types are inferred from text (keys must be read as strings).
TEXT_FORMATS = ("csv", "json", "text")


def has_glob(path: str) -> bool:
    return bool(GLOB_CHARS.search(path))


def read_source(spark: SparkSession, path: str, fmt: str = "csv", *, delimiter: str = ",",
                header: bool = True, infer_schema: bool = True,
                schema: StructType | str | None = None,
                string_columns: Sequence[str] = (), lineage_column: str = "Source",
                options: dict[str, str] | None = None) -> DataFrame:
    """Read ``path`` as ``fmt``.

    * ``fmt="table"`` reads a catalog table (``db.table``) - A5.
    * CSV: ``header`` / ``delimiter`` / ``inferSchema`` as given. Columns in
      ``string_columns`` are read as strings from the start (no infer-then-
      cast, which would lose leading zeros). Inferring the other columns'
      types reads the text once more than the load itself; with a ``schema``,
      or without inference, only the header is read before the load.
    * NaN becomes NULL: the library's single notion of missing.
    * A path below ``/dbfs/`` is the mount of ``dbfs:/``.
    * A path with glob characters gets ``lineage_column`` = base file name of
      each row's file (A3); a directory path reads every file in it (A4).
    """
    if fmt == "table":
        return spark.read.table(path)
    if path.startswith("/dbfs/"):
        path = "dbfs:/" + path[len("/dbfs/"):]
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", str(header).lower()).option("delimiter", delimiter)
        if schema is None:
            reader = reader.option("inferSchema", str(infer_schema).lower())
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    text_format = fmt in TEXT_FORMATS
    if schema is not None:
        reader = reader.schema(schema)
    elif string_columns and text_format:
        reader = reader.schema(_schema_with_strings(spark, path, fmt, delimiter, header,
                                                    infer_schema, string_columns, options))
    df = reader.load(path)
    if string_columns and not text_format and schema is None:
        # typed formats store the key's type; a cast loses nothing there
        for c in string_columns:
            df = df.withColumn(c, F.col(c).cast("string"))
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    if floats:
        df = df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(df.schema[c].dataType)) for c in floats})
    if has_glob(path):
        df = df.withColumn(lineage_column, last_path_segment(F.col("_metadata.file_path")))
    return df


def _schema_with_strings(spark, path, fmt, delimiter, header, infer_schema, string_columns,
                         options) -> StructType:
    probe = spark.read.format(fmt)
    if fmt == "csv":
        probe = (probe.option("header", str(header).lower()).option("delimiter", delimiter)
                 .option("inferSchema", str(infer_schema).lower()))
    for k, v in (options or {}).items():
        probe = probe.option(k, v)
    fields = probe.load(path).schema.fields
    wanted = set(string_columns)
    return StructType([StructField(f.name, StringType(), True) if f.name in wanted else f
                       for f in fields])


def read_stage(spark: SparkSession, base: str, name: str, stage: str = "raw",
               fmt: str = "parquet") -> DataFrame:
    """Reload a saved grand table by stage (``raw`` / ``preprocessed``)."""
    return read_source(spark, f"{base.rstrip('/')}/{name}_{stage}", fmt)
