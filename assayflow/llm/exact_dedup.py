"""Exact dedup with a two-pass Bloom filter (operator 2).

Pass 1 counts how often every Bloom cell is hit and keeps the cells hit at
least twice as a bitmap of bounded size. Pass 2 tests every row: a row whose
cells were not all hit twice has a hash of its own and passes straight
through; only the others shuffle, and there the hash decides exactly. A
filter that is too small for its corpus lets more rows shuffle, no more.

Defined results: NULL text counts as empty; texts are equal when identical
after deleting space, tab, LF, VT, FF and CR; of equal texts the row with the
most code points stays, then the smallest doc_id (NULL last); of rows that
repeat both text and doc_id exactly one stays. An empty table gives no rows.
Extra columns of the input pass through ``drop_duplicates`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.common import bitmap_of_cells, cell_count, materialize, table

#: Deleted before texts are compared (fixed by the contract).
SPACE = r"[\x20\x09-\x0D]+"
#: Cells per hash: two bits in one 64-bit block.
PROBES = 2


def text_sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "").cast("binary"), 256)


def _block_and_mask(key: Column, cells: int) -> tuple[Column, list[Column]]:
    """The block of a 64-bit key and its bit positions inside it."""
    block = F.pmod(key, F.lit(cells >> 6))
    bits = [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64)) for i in range(PROBES)]
    return block, bits


def repeated_cells(keys: DataFrame, column: str, cells: int) -> DataFrame:
    """Pass 1: (block, bits) of the cells hit by two or more rows."""
    block, bits = _block_and_mask(F.col(column), cells)
    hit = keys.select(F.explode(F.array_distinct(F.array(*[block * 64 + b for b in bits]))).alias("cell"))
    twice = hit.groupBy("cell").agg(F.count(F.lit(1)).alias("hits")).filter("hits > 1")
    return bitmap_of_cells(twice, "cell")


def with_maybe(rows: DataFrame, column: str, bitmap: DataFrame, cells: int) -> DataFrame:
    """Pass 2: add ``_maybe``, false where the key is certainly not in the
    bitmap. The bitmap has at most ``MAX_CELLS / 64`` rows by construction,
    so it is broadcast."""
    block, bits = _block_and_mask(F.col(column), cells)
    mask = F.lit(0).cast("bigint")
    for b in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b.cast("int")))
    found = F.broadcast(bitmap.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")))
    tested = rows.withColumn("_block", block).join(found, "_block", "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))
    return tested.withColumn("_maybe", maybe).drop("_block", "_bits")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_code, text_sha256, key, row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    fp = docs.select("doc_id", F.length(text).alias("n_code"), text_sha256(text).alias("text_sha256"),
                     F.monotonically_increasing_id().alias("row"))
    return fp.withColumn("key", F.xxhash64("text_sha256"))


def dedup_table(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every input row."""
    fp = materialize(fingerprints(docs))
    cells = cell_count(fp.count())
    tested = with_maybe(fp, "key", repeated_cells(fp, "key", cells), cells)
    alone = tested.filter(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    shared = tested.filter("_maybe")
    rank = F.struct((-F.col("n_code")).alias("n"), F.col("doc_id").isNull().alias("null_id"), "doc_id", "row")
    groups = (shared.groupBy("text_sha256")
              .agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
              .select("text_sha256", F.col("best.doc_id").alias("keep_id"),
                      F.col("best.row").alias("keep_row"), "group_size"))
    # written, so that the join reads two plain sides and can split a hot group
    groups = materialize(groups)
    decided = shared.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    return alone.unionByName(decided)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows with a hash of their own never shuffle. Of the others, a group is
    reduced to its best row by partial aggregation before the shuffle, so a
    group of any size costs one row per task.
    """
    sha = text_sha256(F.col("text"))
    keys = materialize(docs.select(F.xxhash64(sha).alias("key")))
    cells = cell_count(keys.count())
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("whole"), sha.alias("sha"))
    tested = with_maybe(rows.withColumn("key", F.xxhash64("sha")), "key",
                        repeated_cells(keys, "key", cells), cells)
    text = F.coalesce(F.col("whole.text"), F.lit(""))
    rank = F.struct((-F.length(text)).alias("n"), F.col("whole.doc_id").isNull().alias("null_id"),
                    F.col("whole.doc_id").alias("doc_id"), F.xxhash64(text).alias("tie"))
    best = tested.filter("_maybe").groupBy("sha").agg(F.min_by("whole", rank).alias("whole"))
    alone = tested.filter(~F.col("_maybe")).select("whole")
    return alone.union(best.select("whole")).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_table(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_code,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept,
       text_sha256
FROM n
WINDOW best AS (PARTITION BY text_sha256 ORDER BY n_code DESC, doc_id NULLS LAST)
"""
