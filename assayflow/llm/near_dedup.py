"""Near-duplicates by order MinHash (operator 10).

Words are lower-cased runs of letters and digits. Every five-word shingle is
labelled with its occurrence number in the text, so repetition counts. Each of
``SKETCHES`` sketches ranks the labelled shingles by its own hash, takes the
``TAKE`` smallest and keeps them in text order: two texts share a sketch only
if the same shingles win in the same order, which makes it sensitive to edit
similarity. A pair with shingle similarity 0.8 shares a sketch with
probability of about 0.6, so it misses all 16 about once in two million.

Candidates share a sketch value. A candidate pair is verified by a banded
alignment of the word sequences (bit-parallel edit distance inside the band
that the threshold allows): similarity = 1 - distance / longer length, 0.8 or
more. Blocks that moved break an alignment but keep their shingles, so a pair
that fails it also links when its shingle similarity is 0.8 or more.

Texts with equal words form one class first, and only one of them goes on. In
a bucket every text is first compared with the bucket's smallest one: a star,
never all pairs, so a group of near copies costs one comparison per member
and bucket. Components of the links are the classes so far. What stars leave
apart is taken up by a second pass under the same rule: all members of one
bucket in different components are compared, so a class depends on its texts
alone. Only pairs with too few word pairs in common for the rule are not
aligned (a lower bound: one edit destroys two word pairs at most), nor pairs
whose components already met in the task. Blocks of about ``BLOCK`` members
are compared with each other, so a large bucket is many small tasks; members
of a bucket's largest component meet only those outside it, and a pair is
compared only at its first common sketch.

Defined results: a text without words (NULL and empty included) is a class of
its own; a text of fewer than five words has one shingle, all its words; rows
that repeat doc_id and text are one class; NULL ids are allowed; class_id is
the smallest doc_id of the class (NULL last); extra columns are ignored by the
table and kept by the filter; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.common import (
    cell_count, connected_components, give_back, joined_components, materialize, own_copy, table,
)
from assayflow.llm.exact_dedup import repeated_cells, with_maybe

SHINGLE = 5
SIMILAR = 0.8
SKETCHES, TAKE = 16, 2
#: Second pass: members a block, and word pairs a step of their count.
BLOCK, STEP = 128, 4096
#: Texts a worker holds as Python strings at a time, and words whose hashes it keeps.
TEXTS, KNOWN = 256, 1 << 15
WORD = re.compile(r"[^\W_]+")

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xBF58476D1CE4E5B9)
_SALTS = np.array([(0x2545F4914F6CDD1D * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF for i in range(SKETCHES)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _STEP
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Stable 64-bit hashes; ``known`` is a bounded cache."""
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            if len(known) >= KNOWN:
                known.clear()
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hash of every five-word window (one window if there are fewer words)."""
    width = min(SHINGLE, len(hashes))
    out = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
    for i in range(width):
        out = _mixed(out * _MIX + hashes[i:len(hashes) - width + 1 + i])
    return out


def labelled(grams: np.ndarray) -> np.ndarray:
    """Shingles with the number of their occurrence mixed in; the first
    occurrence keeps its hash, so it has one label in every text."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    if new.all():
        return grams
    at = np.arange(len(grams))
    occurrence = np.empty(len(grams), dtype=np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(occurrence > 0, _mixed(grams + occurrence * _MIX), grams)


def sketches(hashes: np.ndarray) -> np.ndarray:
    """Order MinHash values of one text (signed 64-bit)."""
    grams = labelled(shingles(hashes))
    rank = _mixed(grams[None, :] ^ _SALTS[:, None])
    take = min(TAKE, len(grams))
    if take < len(grams):
        first = np.sort(np.argpartition(rank, take, axis=1)[:, :take], axis=1)
    else:
        first = np.broadcast_to(np.arange(take), (SKETCHES, take))
    value = _SALTS
    for i in range(take):
        value = _mixed(value * _MIX + grams[first[:, i]])
    return value.astype(np.int64)


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences, or ``most + 1`` if it is larger.

    Columns of the dynamic programme are bit vectors of their vertical
    differences; only the diagonals within ``most`` of the main one are kept,
    as a window that moves down one row per column.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    a, b = a[head:n - tail], b[head:m - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) if max(n, m) <= most else most + 1
    # row r of column c sits at bit r - c + most of a window of 2 * most + 1
    width = 2 * most + 1
    window = (1 << width) - 1
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << (i + most))
    plus, minus = window & ~((1 << most) - 1), 0   # column 0: rows count up
    score = most                                    # value at the window's last row
    for j, x in enumerate(b):
        match = (where.get(x, 0) >> j) & window
        zero = ((((match & plus) + plus) ^ plus) | match | minus) & window
        h_plus = minus | (window & ~(zero | plus))
        h_minus = zero & plus
        # the window moves down a row: its last row follows the last diagonal
        if not (zero >> (width - 1)) & 1:
            score += 1
        shifted = zero >> 1
        plus = (h_minus | (window & ~(shifted | h_plus))) & window
        minus = h_plus & shifted
    # from the window's last row back up to row n of the last column
    row = m + most
    bit = width - 1
    while row > n:
        if (plus >> (bit - 1)) & 1:
            score -= 1
        elif (minus >> (bit - 1)) & 1:
            score += 1
        row -= 1
        bit -= 1
    return score if score <= most else most + 1


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two word sequences are near duplicates."""
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    most = int(longer * (1 - SIMILAR) + 1e-9)
    if longer - shorter > most:
        return False
    ga, gb = labelled(shingles(a)), labelled(shingles(b))
    common = len(np.intersect1d(ga, gb, assume_unique=True))
    if common >= SIMILAR * (len(ga) + len(gb) - common):
        return True
    # words in common bound the alignment from above
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if longer - int(np.minimum(ca[ia], cb[ib]).sum()) > most:
        return False
    return banded_distance(a, b, most) <= most


def word_pairs(hashes: np.ndarray) -> np.ndarray:
    """Labelled pairs of neighbouring words, sorted."""
    return np.sort(labelled(_mixed(hashes[:-1] * _MIX + hashes[1:]))) if len(hashes) > 1 else hashes[:0]


def in_common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common values of every left and every right set, by steps of
    ``STEP`` values that occur on both sides."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    cut = lambda sets: [np.searchsorted(shared, np.intersect1d(s, shared, assume_unique=True)) for s in sets]
    left, right = cut(left), cut(right)
    for low in range(0, len(shared), STEP):
        sides = []
        for sets in (left, right):
            held = np.zeros((len(sets), STEP), dtype=np.float32)
            for row, s in zip(held, sets):
                row[s[np.searchsorted(s, low):np.searchsorted(s, low + STEP)] - low] = 1
            sides.append(held)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def may_be_alike(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs can be alike by their lengths and word pairs in common;
    False only where neither alignment nor shingles can reach the threshold."""
    nl, nr = (np.array([len(w) for w in side]) for side in (left, right))
    longer, shorter = np.maximum(nl[:, None], nr[None, :]), np.minimum(nl[:, None], nr[None, :])
    most = (longer * (1 - SIMILAR) + 1e-9).astype(np.int64)
    need = np.minimum(longer - 1 - 2 * most, SIMILAR * (longer - SHINGLE + 1) - 1e-9)
    common = in_common([word_pairs(w) for w in left], [word_pairs(w) for w in right])
    return (longer - shorter <= most) & (common >= need)


# ------------------------------------------------------------- signatures
def _text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes that name a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Batches by ``TEXTS`` rows, their other columns as copies, with the words
    of their texts. What a batch took goes back."""
    for batch in batches:
        others = [n for n in batch.schema.names if n != "text"]
        for at in range(0, len(batch), TEXTS):
            part = batch.slice(at, TEXTS)
            words = [WORD.findall(t.lower()) if t else [] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([own_copy(part.column(n)) for n in others], names=others), words
            del part, words
        del batch
        give_back()
    give_back()     # the last batch is free only once its reader has ended


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch, texts in _stretches(batches):
        nodes = [xxhash.xxh3_128_digest(" ".join(words)) if words else None for words in texts]
        sizes = [len(words) for words in texts]
        flat = [np.empty(0, np.int64), *[sketches(_word_hashes(words, known)) for words in texts if words]]
        ends = np.cumsum([0, *[SKETCHES if words else 0 for words in texts]])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(nodes, pa.binary()),
             pa.array(sizes, pa.int32()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))],
            names=["doc_id", "k1", "k2", "node", "n_words", "sketches"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, node (names the word sequence), n_words, sketches."""
    rows = docs.select("doc_id", *_text_keys(F.col("text")), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_signed, f"doc_id {kind}, k1 long, k2 long, node binary, n_words int, sketches array<long>")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch, texts in _stretches(batches):
        words = pa.array([_word_hashes(words, known).tobytes() for words in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("node"), words], names=["node", "words"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that are near duplicates; words are read where they lie."""
    read = lambda cell: np.frombuffer(cell.as_buffer(), dtype=np.uint64)
    for batch in batches:
        near = [alike(read(a), read(b)) for a, b in zip(batch.column("words_a"), batch.column("words_b"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(near, pa.bool_())) for n in "ab"], names=["a", "b"])
        del batch
        give_back()
    give_back()


# ------------------------------------------------------------------ links
def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near duplicates."""
    side = lambda n: words.select(F.col("node").alias(n), F.col("words").alias(f"words_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "words_a", "words_b").mapInArrow(_alike, "a binary, b binary")


def _block_links(members: pd.DataFrame) -> pd.DataFrame:
    """Links of one bucket and one pair of blocks that join two components."""
    i, j, band = (members[c].iloc[0] for c in ("i", "j", "band"))
    left, right = members[members["block"] == i], members[members["block"] == j]
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": []})
    same = np.stack(left["sketches"])[:, None, :] == np.stack(right["sketches"])[None, :, :]
    apart = left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]
    take = apart & same.any(axis=2) & (same.argmax(axis=2) == band)
    if i == j:
        take &= left["node"].to_numpy()[:, None] < right["node"].to_numpy()[None, :]
    if not take.any():
        return pd.DataFrame({"a": [], "b": []})
    wl, wr = ([np.frombuffer(x, np.uint64) for x in m["words"]] for m in (left, right))
    root: dict = {}

    def find(x: bytes) -> bytes:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    links = []
    for at, to in zip(*np.nonzero(take & may_be_alike(wl, wr))):
        a, b = find(left["component"].iat[at]), find(right["component"].iat[to])
        if a != b and alike(wl[at], wr[to]):
            root[a] = b
            links.append((left["node"].iat[at], right["node"].iat[to]))
    return pd.DataFrame(links, columns=["a", "b"])


def _apart(members: DataFrame, components: DataFrame, words: DataFrame) -> DataFrame:
    """Links of the second pass: bucket members in different components (the
    pivot has met them all)."""
    named = materialize(members.filter("node <> pivot").select("bucket", "band", "node").join(components, "node", "left")
                        .withColumn("component", F.coalesce("component", "node")))
    counts = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("main"))
    split = named.join(materialize(buckets.filter("main.n < size")), "bucket").join(words, "node")
    main = F.col("component") == F.col("main.component")
    outside = F.ceil((F.col("size") - F.col("main.n")) / BLOCK).cast("int")
    inside = F.ceil(F.col("main.n") / BLOCK).cast("int")
    spot = F.xxhash64("node")
    dealt = split.withColumn("block", F.when(main, outside + F.pmod(spot, inside)).otherwise(F.pmod(spot, outside)).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(
        F.lit(0), F.when(main, outside).otherwise(outside + inside) - 1)).alias("with"))
    dealt = dealt.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    return dealt.select("bucket", "band", "i", "j", "block", "node", "component", "sketches", "words") \
        .groupBy("bucket", "i", "j").applyInPandas(_block_links, "a binary, b binary")


def near_links(docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, components) between the nodes (k1, k2, node,
    sketches); components covers nodes with a link."""
    each = nodes.select("node", F.posexplode("sketches").alias("band", "value")).select(
        "node", "band", F.xxhash64("band", "value").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot <> last")
    members = materialize(each.join(shared.select("bucket", "pivot"), "bucket"))
    stars = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()

    wanted = members.select("node").distinct().join(nodes.select("node", "k1", "k2"), "node")
    texts = docs.select(*_text_keys(F.col("text")), "text").join(wanted, ["k1", "k2"])
    words = materialize(texts.groupBy("node").agg(F.first("text").alias("text"))
                        .mapInArrow(_packed, "node binary, words binary"))
    links = materialize(_verified(stars, words))
    components = connected_components(links)
    more = materialize(_apart(members, components, nodes.select("node", "sketches").join(words, "node")))
    if more.limit(1).count():
        links = links.union(more)
        components = joined_components(components, more)
    return links, components


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows has doc_id, k1, k2, node, class_node; classes has
    class_node, class_id, k1, k2 (of the document that stays), class_size."""
    sig = materialize(signatures(docs))
    nodes = materialize(sig.filter("n_words > 0").groupBy("node").agg(
        F.min(F.struct("k1", "k2")).alias("k"), F.first("n_words").alias("n_words"),
        F.first("sketches").alias("sketches")).select("k.k1", "k.k2", "node", "n_words", "sketches"))
    _, components = near_links(docs, nodes)
    rows = materialize(sig.select("doc_id", "k1", "k2", "node").join(components, "node", "left").select(
        "doc_id", "k1", "k2", "node", F.coalesce("component", "node").alias("class_node")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "k1", "k2")).alias("first")
    of = rows.filter("class_node is not null").groupBy("class_node").agg(first, F.count(F.lit(1)).alias("class_size"))
    return rows, materialize(of.select("class_node", F.col("first.doc_id").alias("class_id"),
                                       F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), "class_size"))


def class_table(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size for every input row."""
    rows, of = classes(docs)
    shared = of.filter("class_size > 1").select("class_node", "class_id", "class_size")
    return rows.join(shared, "class_node", "left").select(
        "doc_id", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, one per class, with all their columns.

    Rows that are in a class with others are found by a bounded bitmap of
    their keys; all other rows pass straight through without a shuffle."""
    rows, of = classes(docs)
    shared = rows.join(of.filter("class_size > 1").select(
        "class_node", F.col("class_id").alias("keep_id"), F.col("k1").alias("keep_k1"), F.col("k2").alias("keep_k2")),
        "class_node")
    stays = (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("k1") == F.col("keep_k1"))
             & (F.col("k2") == F.col("keep_k2")))
    decided = materialize(shared.select(F.xxhash64("doc_id", "k1", "k2").alias("key"), "k1", stays.alias("stays")).distinct())
    cells = cell_count(decided.count())
    twice = decided.select("key").union(decided.select("key"))   # the bitmap keeps cells hit twice
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    keyed = docs.select(whole, F.col("doc_id").alias("_id"), *_text_keys(F.col("text"))).select(
        "whole", "k1", F.xxhash64("_id", "k1", "k2").alias("key"))
    tested = with_maybe(keyed, "key", repeated_cells(twice, "key", cells), cells)
    met = tested.filter("_maybe").join(decided, ["key", "k1"], "left").select("whole", "key", "k1", "stays")
    one = met.filter("stays").groupBy("key", "k1").agg(F.first("whole").alias("whole")).select("whole")
    rest = tested.filter("not _maybe").select("whole").union(met.filter("stays is null").select("whole"))
    return rest.union(one).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_table(table(spark, sf_dir, "documents"))
