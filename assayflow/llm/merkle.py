"""Merkle manifest of a dataset by concatenated-level strings (operator 11).

Rows are leaves, trees have eight children a node. Leaves get their place in
their group (language) from a range-partitioned sort; every 512 consecutive
places form an aligned block. A block keeps each of its levels as one string
of 64 hex digits a node, so a parent is the hash of a fixed-width substring of
512 digits, and the siblings of a node are the two substrings that flank it in
its run. The hashes of the blocks are the leaves of the next, 512 times
smaller tree, which is built and proved by the same code, and so are the roots
of the groups in the end. No group ever sits in one task: a block holds 512
nodes at most.

Defined results: NULL fields count as ``-``; NULL text stays NULL when it is
tampered with; NULL groups come first, as a group of their own; NULL order
keys come first in their group, equal ones ascend by leaf, and rows equal in
all fields are leaves of their own, side by side; a group with one leaf has
that leaf as its root, one group's root is the root of all; texts of any
length are hashed whole; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.common import CRC_TABLE_SQL, crc32_sql, materialize, positions, table

ARITY, HEX = 8, 64
RUN = ARITY * HEX
#: Levels inside a block, and the nodes of a block.
LEVELS = 3
BLOCK = ARITY ** LEVELS
#: The fields of a leaf, in order (fixed by the contract).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:binary,right:binary>>"


def digest(content: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes or of a binary."""
    return F.sha2(content.cast("binary"), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """The hash of a row: each field as its byte count, ``:`` and value."""
    def coded(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return digest(F.concat(*[coded(f) for f in fields]))


def _parents(level: Column) -> Column:
    """The level above a string of nodes."""
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / RUN).cast("int") - 1)
    hashes = F.transform(runs, lambda i: F.sha2(F.substring(level, i * RUN + 1, F.lit(RUN)), 256))
    return F.array_join(hashes, "").cast("binary")


def _blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """(grp, pos, node, carried...) to one written row per block: its rows in
    order, its levels (NULL beyond the last) and its hash.

    A first block of fewer than 512 nodes is its whole group, and its levels
    end where one node is left; all other blocks have three levels above their
    nodes, single-node runs included."""
    row = F.struct((F.col("pos") % BLOCK).cast("int").alias("i"), "node", *carried)
    blocks = nodes.groupBy("grp", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.array_sort(F.collect_list(row)).alias("rows"))
    goes_on = (F.col("block") > 0) | (F.size("rows") == BLOCK)
    blocks = blocks.withColumn("level0", F.array_join(F.transform("rows", lambda r: r["node"]), "").cast("binary"))
    for k in range(LEVELS):
        below = F.col(f"level{k}")
        blocks = blocks.withColumn(f"level{k + 1}", F.when(goes_on | (F.octet_length(below) > HEX), _parents(below)))
    top = F.coalesce(*[F.col(f"level{k}") for k in range(LEVELS, -1, -1)]).cast("string")
    return materialize(blocks.withColumn("top", top).drop(f"level{LEVELS}").withColumn(
        "heights", F.when(goes_on, LEVELS).otherwise(sum(
            F.when(F.octet_length(f"level{k}") > HEX, 1).otherwise(0) for k in range(LEVELS)))))


def _flanks(level: Column, at: Column) -> Column:
    """The siblings of a node: the substrings before and after it in its run."""
    inside = at % ARITY
    return F.struct(
        F.substring(level, (at - inside) * HEX + 1, inside * HEX).alias("left"),
        F.substring(level, (at + 1) * HEX + 1, (F.lit(ARITY - 1) - inside) * HEX).alias("right"))


def _proved(blocks: DataFrame, above: DataFrame, *carried: str) -> DataFrame:
    """Rows of the blocks with their siblings, lowest level first, and the
    root of their group. ``above`` has (grp, block, path, root) per block."""
    whole = blocks.join(above, ["grp", "block"])

    def row(r: Column) -> Column:
        own = F.array(*[_flanks(F.col(f"level{k}"), F.shiftright(r["i"], 3 * k)) for k in range(LEVELS)])
        return F.struct((F.col("block") * BLOCK + r["i"]).alias("pos"), r["node"].alias("node"),
                        *[r[c].alias(c) for c in carried],
                        F.concat(F.slice(own, F.lit(1), F.col("heights")), F.col("path")).alias("path"))
    return whole.select("grp", "root", F.inline(F.transform("rows", row)))


def _above(blocks: DataFrame) -> DataFrame:
    """(grp, block, path, root) of every block: the tree over the blocks."""
    nodes = blocks.select("grp", F.col("block").alias("pos"), F.col("top").alias("node"))
    if not blocks.filter("block > 0").limit(1).count():   # every group is one block
        return nodes.select("grp", F.col("pos").alias("block"), F.array().cast(PATH).alias("path"),
                            F.col("node").alias("root"))
    higher = _blocks(nodes)
    return materialize(_proved(higher, _above(higher)).select("grp", F.col("pos").alias("block"), "path", "root"))


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, node, lambda acc, s: F.sha2(F.concat(s["left"], acc.cast("binary"), s["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, left to right (binary)."""
    return F.aggregate(path, F.lit(b""), lambda acc, s: F.concat(acc, s["left"], s["right"]))


def manifest(rows: DataFrame, group: Column, order: Column, node: Column, **carried: Column) -> DataFrame:
    """node, carried columns, path, subroot and root of every row.

    ``group`` is a string; ``path`` lists the siblings (left, right) of each
    level from the leaf through the group's root to the root of all, so that
    ``folded(node, path)`` equals ``root`` for untouched rows."""
    leaves = materialize(rows.select(
        F.coalesce(F.concat(F.lit("1"), group), F.lit("0")).alias("grp"),   # NULL first
        order.alias("key"), node.alias("node"), F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in carried.items()]).alias("carried"),
        F.monotonically_increasing_id().alias("row")))
    blocks = _blocks(positions(leaves, "grp", ["key", "node", "row"]), "carried")
    above = _above(blocks)
    subroots = above.filter("block = 0").select(
        F.lit("").alias("all"), F.col("grp").alias("key"), F.col("root").alias("node"))
    tops = _blocks(positions(materialize(subroots), "all", ["key"]).withColumnRenamed("all", "grp"), "key")
    over = materialize(_proved(tops, _above(tops), "key").select(
        F.col("key").alias("grp"), F.col("path").alias("over"), F.col("root").alias("whole")))
    joined = above.join(over, "grp").select("grp", "block", F.concat("path", "over").alias("path"),
                                            F.struct(F.col("root").alias("sub"), "whole").alias("root"))
    return _proved(blocks, materialize(joined), "carried").select(
        "node", *[F.col("carried").getField(k).alias(k) for k in carried], "path", F.col("root.sub").alias("subroot"), F.col("root.whole").alias("root"))


def manifest_table(docs: DataFrame) -> DataFrame:
    """The manifest of documents, each row checked after the tampering of the
    contract: leaf, subroot, root, proof_sha256, folded_root, verified."""
    fields = [F.col(f) for f in FIELDS]
    lower = [F.translate(F.col("text"), UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS]
    touched = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    whole = manifest(docs, F.col("lang"), F.col("doc_id"), leaf(fields), doc_id=F.col("doc_id"),
                     tampered=F.when(touched, leaf(lower)))
    found = whole.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "node"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_table(table(spark, sf_dir, "documents"))


def _sql(levels: int = 8) -> str:
    """The same levels as joins of node tables; eight levels reach 8^8 leaves
    a language."""
    def hashed(text: str) -> str:
        coded = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in
                 [text if f == "text" else f for f in FIELDS]]
        return f"sha256({' || '.join(coded)})"

    def climb(name: str, start: str) -> list[str]:
        """Levels of the trees of ``start`` (grp, id, pos, node): one row per
        node and level, with its flanks where its group has more than it."""
        out = [f"""{name}0 AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM ({start}))"""]
        for k in range(levels):
            out.append(f"""{name}f{k} AS (SELECT grp, pos, n,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k} WINDOW w AS (PARTITION BY grp, pos // 8 ORDER BY pos))""")
            out.append(f"""{name}{k + 1} AS (SELECT grp, pos // 8 AS pos,
    CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node,
    (any_value(n) + 7) // 8 AS n FROM {name}{k} GROUP BY grp, pos // 8)""")
        return out

    def fold(name: str, before: str) -> tuple[list[str], str]:
        out = []
        for k in range(levels):
            out.append(f"""{name}x{k} AS (SELECT x.* EXCLUDE (pos, proof, f), x.pos // 8 AS pos,
    x.proof || l || r AS proof, CASE WHEN y.n = 1 THEN f ELSE sha256(l || f || r) END AS f
  FROM {before} x JOIN {name}f{k} y ON x.{name}g = y.grp AND x.pos = y.pos)""")
            before = f"{name}x{k}"
        return out, before

    leaves = f"""leaves AS (SELECT doc_id, leaf, tampered, coalesce('1' || lang, '0') AS dg,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, lang, {hashed('text')} AS leaf,
    CASE WHEN {crc32_sql("list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, (i + 1)::INT, 1)))")} % 3 = 0
    THEN {hashed(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered
  FROM documents, tab))"""
    inner = climb("d", "SELECT dg AS grp, pos, leaf AS node FROM leaves")
    outer = climb("t", f"SELECT 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, node, grp AS dg FROM d{levels}")
    first, done = fold("d", "started")
    second, last = fold("t", "moved")
    return f"""WITH tab AS ({CRC_TABLE_SQL}),
{leaves},
{", ".join(inner)},
{", ".join(outer)},
started AS (SELECT doc_id, leaf, dg, pos, '' AS proof, coalesce(tampered, leaf) AS f FROM leaves),
{", ".join(first)},
moved AS (SELECT x.* EXCLUDE (pos, dg), 0 AS tg, y.pos AS pos, y.node AS subroot FROM {done} x JOIN t0 y ON x.dg = y.dg),
{", ".join(second)}
SELECT doc_id, leaf, subroot, y.node AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = y.node AS verified
FROM {last} x, t{levels} y
"""


SQL = _sql()
