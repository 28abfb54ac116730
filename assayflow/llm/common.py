"""Helpers shared by the training-data operators: table access, materialised
intermediate tables, bounded bitmaps and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayflow.session import table_path

#: crc32(doc_id as text) mod 4 equal to this marks the held-out quarter.
HELD_OUT_FOLD = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: lineage ends there, and the planner knows the table's size."""
    spark = df.sparkSession
    path = table_path(spark, f"llm-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What a Python worker has freed goes back to the system. Workers stay
    for later tasks, and the batches that Spark sends lie in the C heap, which
    keeps them otherwise (other C libraries have no such call)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.pythonapi, "malloc_trim", None)
    if trim is not None:
        trim(ctypes.c_size_t(0))


def own_copy(column: pa.Array) -> pa.Array:
    """A column apart from the batch that it was cut from, which is held as
    long as one of its columns is."""
    return pa.concat_arrays([column, column.slice(0, 0)])


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the held-out quarter (NULL id: no)."""
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


def words_expr(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` in the text, in order (NULL text: none)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def sql_strings(values: Sequence[str]) -> str:
    """A SQL list of quoted strings."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def long_array(values: Sequence[int]) -> Column:
    """A literal array of bigints that the optimizer folds once."""
    return F.expr("array(" + ", ".join(f"{int(v)}L" for v in values) + ")")


# ---------------------------------------------------------------- bitmaps
#: The largest bitmap a task may hold: 2^26 cells are 8 MB of bits in at most
#: 2^20 rows. A fuller bitmap only lets more rows through to the exact step.
MAX_CELLS = 1 << 26


def cell_count(n_keys: int, per_key: int = 16) -> int:
    """Cells of a bitmap for ``n_keys`` keys: a power of two, bounded."""
    cells = 1 << 12
    while cells < n_keys * per_key and cells < MAX_CELLS:
        cells <<= 1
    return cells


def bitmap_of_cells(cells: DataFrame, column: str) -> DataFrame:
    """Pack distinct cell numbers into (block, bits) rows of 64 cells."""
    block = F.shiftright(F.col(column), 6).alias("block")
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    return cells.groupBy(block).agg(F.bit_or(bit).alias("bits"))


def _rooted(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent replaced by the end of its chain."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        step = materialize(parents.join(up, "parent").select("node", "root", (F.col("root") != F.col("parent")).alias("moved")))
        parents = step.select("node", F.col("root").alias("parent"))
        if not step.filter("moved").limit(1).count():
            return parents


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, component): the smallest node reachable.

    Each round points every node at its smallest neighbour (or itself),
    follows the pointers to their end and contracts the links to those ends;
    links inside a component vanish, so rounds shrink quickly and a star takes
    one. Minima over a hot node's neighbours are partial aggregates, its links
    join under adaptive skew splitting, and every table is written.
    """
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while found is None or edges.limit(1).count():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        roots = _rooted(materialize(both.groupBy("node").agg(F.min("near").alias("near"))
                                    .select("node", F.least("node", "near").alias("parent"))))
        left = roots.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = roots.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = materialize(edges.join(left, "a").join(right, "b").filter("pa <> pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if found is None:
            found = roots
        else:
            up = roots.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
            found = materialize(found.join(up, "parent", "left").select(
                "node", F.coalesce("root", "parent").alias("parent")))
    return found.select("node", F.col("parent").alias("component"))


def joined_components(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` with more links between their nodes (a node without a
    component is its own)."""
    name = lambda n: components.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))
    between = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("into"))
    known = components.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    new = merged.select(F.col("component").alias("node"), F.col("into").alias("component")).join(
        components.select("node"), "node", "left_anti")
    return materialize(known.union(new))


# ------------------------------------------------------------------ positions
def positions(rows: DataFrame, group: str, order: Sequence[str], out: str = "pos") -> DataFrame:
    """Written rows with their gapless place, from 0, in the order (group,
    ``order``) of their group.

    The sort is dealt by ranges of the whole key, so a hot group spreads over
    many tasks if ``order`` tells its rows apart; places come from one count
    per partition and group, a table of partitions plus groups rows.
    """
    at = F.monotonically_increasing_id()
    ordered = materialize(
        rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
        .withColumn("_part", F.shiftright(at, 33).cast("int"))
        .withColumn("_place", at.bitwiseAND(F.lit((1 << 33) - 1))))
    runs = ordered.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")
    offsets = materialize(runs.select("_part", group, (before - F.col("_first")).alias("_shift")))
    return ordered.join(offsets, ["_part", group]).withColumn(out, F.col("_place") + F.col("_shift")).drop(
        "_part", "_place", "_shift")


def crc32_sql(octets: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a list of byte values; the table
    ``tab`` of ``CRC_TABLE_SQL`` must be in scope."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
            "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)")


def _crc_table_sql() -> str:
    entry = "SELECT i, i::BIGINT AS v FROM range(256) r(i)"
    for _ in range(8):
        entry = f"SELECT i, if((v & 1) = 1, xor(v >> 1, 3988292384), v >> 1) AS v FROM ({entry})"
    return f"SELECT list(v ORDER BY i) AS tab FROM ({entry})"


CRC_TABLE_SQL = _crc_table_sql()
