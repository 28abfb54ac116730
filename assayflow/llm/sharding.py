"""Hilbert-curve sharding (operator 7), DataFrame functions only.

Three metadata dimensions (language, source, size) are quantised to 16 cells
each, by equal depth over all rows. Rows are ordered by the index of their
cell on a three-dimensional Hilbert curve and cut into runs, so each shard
covers a compact box of the three dimensions and a reader that filters on any
of them skips most shards. The law is ``rows``: shard counts differ by one at
most. The position inside a shard is gapless.

Equal depth comes from a histogram of at most 65,536 bins per dimension, so
what is broadcast has a fixed bound whatever the corpus. Rows are ranked by a
range-partitioned sort on (curve index, doc_id, checksum, size, row number),
which splits a hot cell by doc_id; offsets come from one count per partition.

Defined results: NULL text has size 8 and the checksum of the empty text;
NULL lang or source sorts in a bin of its own; NULL doc_id sorts first in its
cell; repeated rows get positions of their own, next to each other; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayflow.llm.common import materialize, table

N_SHARDS = 24
BITS = 4
DIMENSIONS = ("lang", "source", "size")
CELLS = 1 << BITS
BINS = 1 << 16


def hilbert_indexes(bits: int = BITS, dims: int = 3) -> list[int]:
    """Curve index of every cell; cell = sum of coordinate << (bits * i).

    Walks the bit planes from the top: each plane contributes ``dims`` bits,
    and the sub-cube's orientation is a reflection and an exchange of axes.
    """
    out = []
    for cell in range(1 << (bits * dims)):
        x = [(cell >> (bits * i)) & ((1 << bits) - 1) for i in range(dims)]
        plane = 1 << (bits - 1)
        while plane > 1:                     # undo the orientation of each plane
            low = plane - 1
            for i in range(dims):
                if x[i] & plane:
                    x[0] ^= low
                else:
                    swap = (x[0] ^ x[i]) & low
                    x[0] ^= swap
                    x[i] ^= swap
            plane >>= 1
        for i in range(1, dims):             # Gray decoding across the axes
            x[i] ^= x[i - 1]
        flip = 0
        plane = 1 << (bits - 1)
        while plane > 1:
            if x[dims - 1] & plane:
                flip ^= plane - 1
            plane >>= 1
        x = [v ^ flip for v in x]
        index = 0
        for b in range(bits - 1, -1, -1):
            for v in x:
                index = (index << 1) | ((v >> b) & 1)
        out.append(index)
    return out


def _name_bin(value: Column) -> Column:
    """One of 65,535 bins of a name, 0 for NULL."""
    digits = F.conv(F.substring(F.md5(value.cast("binary")), 1, 4), 16, 10).cast("int")
    return F.coalesce(F.least(digits + 1, F.lit(BINS - 1)), F.lit(0))


def _base(docs: DataFrame, row: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(text).cast("bigint") + 8
    return docs.select(
        "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"),
        _name_bin(F.col("lang")).alias("bin_lang"), _name_bin(F.col("source")).alias("bin_source"),
        F.least(F.shiftright(size, 4), F.lit(BINS - 1)).cast("int").alias("bin_size"),
        row.alias("row"))


def _cells(base: DataFrame, total: int) -> DataFrame:
    """(dim, bin, cell): equal-depth cell of every used bin, at most 65,536
    rows per dimension."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"bin_{d}").alias("bin"))
                               for i, d in enumerate(DIMENSIONS)])).alias("at")
    bins = base.select(each).groupBy("at.dim", "at.bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("dim").orderBy("bin")) - F.col("n")
    return bins.select("dim", "bin", F.expr("n"), before.alias("before")).select(
        "dim", "bin", F.floor(F.col("before") * CELLS / F.lit(total)).cast("int").alias("cell"))


def _sharded(rows: DataFrame, n_shards: int) -> DataFrame:
    """The table of shards with the row numbers of ``_base``."""
    base = materialize(rows)
    total = base.count()
    cells = materialize(_cells(base, max(1, total)))
    placed = base
    for i, d in enumerate(DIMENSIONS):
        one = cells.filter(F.col("dim") == i).select(F.col("bin").alias(f"bin_{d}"), F.col("cell").alias(f"cell_{d}"))
        placed = placed.join(F.broadcast(one), f"bin_{d}")
    cell = F.col("cell_lang") + F.col("cell_source") * CELLS + F.col("cell_size") * CELLS * CELLS
    curve = F.expr("array(" + ",".join(map(str, hilbert_indexes())) + ")")
    placed = placed.withColumn("curve", F.element_at(curve, cell + 1))

    order = ["curve", "doc_id", "text_crc32", "size", "row"]
    at = F.monotonically_increasing_id()
    ordered = materialize(
        placed.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.shiftright(at, 33).cast("int"))
        .withColumn("place", at.bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(*[f"bin_{d}" for d in DIMENSIONS]))
    # one row per partition of the sort: as few as the shuffle has partitions
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    first = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    ranked = ordered.join(F.broadcast(first), "part").withColumn("rank", F.col("first") + F.col("place"))
    # the first (total mod n) shards hold one row more
    small, more = divmod(total, n_shards)
    edge = more * (small + 1)
    inside = F.col("rank") < edge
    shard = F.when(inside, F.expr(f"rank div {small + 1}")) \
        .otherwise(F.expr(f"{more} + (rank - {edge}) div {max(1, small)}"))
    slot = F.when(inside, F.expr(f"rank % {small + 1}")).otherwise(F.expr(f"(rank - {edge}) % {max(1, small)}"))
    return ranked.select(
        "row", "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[f"cell_{d}" for d in DIMENSIONS], "curve")


def shard_table(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Shard and slot of every row, with the coordinates of its cell."""
    return _sharded(_base(docs, F.monotonically_increasing_id()), n_shards).drop("row")


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """Write documents as one folder per shard, each sorted along the curve,
    with their columns, slot and cell coordinates.

    Documents are written once with a row number and meet their place by it,
    so NULL and repeated ids are written like all others; every file then
    holds one run of the curve."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    kept = materialize(docs.select(whole, F.monotonically_increasing_id().alias("row")))
    named = kept.select("whole.doc_id", "whole.text", "whole.lang", "whole.source", "row")
    spot = ["shard", "slot", *[f"cell_{d}" for d in DIMENSIONS]]
    place = _sharded(_base(named, F.col("row")), n_shards).select("row", *spot)
    (kept.join(place, "row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .select("whole.*", *spot).write.partitionBy("shard").parquet(path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(table(spark, sf_dir, "documents"))


def _sql() -> str:
    curve = ",".join(map(str, hilbert_indexes()))
    name = "coalesce(least(('0x' || substr(md5({0}), 1, 4))::INT + 1, 65535), 0)"
    # the checksum, byte by byte from its 256-entry table
    entry = "SELECT i, i::BIGINT AS v FROM range(256) r(i)"
    for _ in range(8):
        entry = f"SELECT i, if((v & 1) = 1, xor(v >> 1, 3988292384), v >> 1) AS v FROM ({entry})"
    octets = "list_transform(range(strlen(t)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)"
    crc = (f"list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
           "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))")
    cell = " ".join(
        f"""c{i} AS (SELECT b, floor((sum(n) OVER (ORDER BY b) - n) * {CELLS} / (SELECT count(*) FROM base))::INT AS c
  FROM (SELECT b{i} AS b, count(*) AS n FROM base GROUP BY 1)),""" for i in range(3))
    return f"""
WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM ({entry})),
base AS (
  SELECT doc_id, strlen(t) + 8 AS size,
         CASE WHEN t = '' THEN 0 ELSE xor({crc}, 4294967295) END AS text_crc32,
         {name.format('lang')} AS b0, {name.format('source')} AS b1, least((strlen(t) + 8) >> 4, 65535) AS b2
  FROM (SELECT doc_id, lang, source, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents), tab),
{cell}
placed AS (
  SELECT doc_id, size, text_crc32, c0.c AS cell_lang, c1.c AS cell_source, c2.c AS cell_size,
         ([{curve}])[c0.c + {CELLS} * c1.c + {CELLS * CELLS} * c2.c + 1] AS curve
  FROM base JOIN c0 ON b0 = c0.b JOIN c1 ON b1 = c1.b JOIN c2 ON b2 = c2.b),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, text_crc32, size) - 1 AS rank,
         count(*) OVER () // {N_SHARDS} AS small, count(*) OVER () % {N_SHARDS} AS more
  FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law,
       (CASE WHEN rank < more * (small + 1) THEN rank // (small + 1)
             ELSE more + (rank - more * (small + 1)) // greatest(small, 1) END)::INT AS shard,
       (CASE WHEN rank < more * (small + 1) THEN rank % (small + 1)
             ELSE (rank - more * (small + 1)) % greatest(small, 1) END)::BIGINT AS slot,
       NULL::INT AS grown_shard, cell_lang, cell_source, cell_size, curve
FROM ranked
"""


SQL = _sql()
