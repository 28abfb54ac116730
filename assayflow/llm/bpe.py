"""Byte-level BPE encoding and decoding with higher-order functions (operator 6).

The merges of a word are a fold over its array of byte pieces: each step joins
the leftmost adjacent pair of the lowest rank, found in a rank map that is a
constant of the plan. Texts are taken in runs of about ``RUN_BYTES`` bytes; only
the distinct words of a run are folded, and the ids are put in the places of
the words by index. Words of a bounded sample of documents, at most
``CACHE_WORDS`` of them, are folded beforehand into a table; a run's word is
looked up there first, so ids never depend on the sample. Words of more than
``LONG_BYTES`` bytes are folded over the ranked merges instead of over their
steps, each merge replaced in the whole word at once, which costs time in
proportion to their length. Decoding looks up the bytes of every id and
concatenates the pieces.

Of a short word all substrings are looked up in a table of cells by their
hash; the fold takes those that may be pieces in the order of their ranks and
merges where the boundaries allow it and the piece is the same string.

A run is worked on inside one task without a shuffle: its distinct words
travel ahead of its documents. The rank map and the pieces, constants of the
tokenizer, are literals of the plan; no map of the corpus' words is. The word
table is broadcast, at most 2^19 words of 32 bytes.

Defined results: NULL text counts as empty (no ids, empty bytes); each input
row gives one row, repeated rows and NULL ids included; texts and words of
any length are encoded whole; extra columns are ignored by the digest and
kept by ``encode``; an empty table gives no rows.
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from assayflow.llm.common import give_back, long_array, materialize, own_copy, table, words_expr

#: Documents whose distinct words are folded beforehand, the most words kept
#: of them, and the longest word kept (bytes): 100 MB at the very most.
CACHE_DOCS, CACHE_WORDS, CACHE_WORD_BYTES = 16_000, 1 << 19, 32
#: Bytes of the texts that share one fold per distinct word.
RUN_BYTES = 1 << 23
#: Words up to the first length are folded over their ranked merges, with the
#: piece boundaries as bits of a number; words beyond the second are folded
#: over the merges as strings.
SHORT_BYTES, LONG_BYTES = 22, 2048
#: Follows every word of a text on the way to Python.
BREAK = "\x1e"
#: Powers of two: the cells of the ranks, the buckets of the map for shared cells.
RANK_CELLS, RANK_BUCKETS = 1 << 20, 1 << 12
#: Stands for "no merge" in the fold.
NO_RANK = 1 << 30
TOKENIZER = "byte_bpe_50k.tiktoken"


# Fixed value: the characters that Unicode calls white space.
WHITE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def split_pattern() -> str:
    """The public pattern in the JVM's syntax: white space spelled out, and
    the alternatives that start with a letter or digit tried first. No two
    alternatives before the last three start alike, so their order is free."""
    public = importlib.import_module("public_tokenizers").PATTERN
    expected = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    if public != expected:
        raise ValueError("the public split pattern has changed")
    return (r" ?\p{L}++| ?\p{N}++|'(?:[stmd]|re|ve|ll)"
            rf"| ?[^{WHITE}\p{{L}}\p{{N}}]++|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def read_ranks(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(piece binary, rank int) of a rank file. The file is a local parameter
    of the driver, like a configuration; it has a fixed number of lines."""
    path = path or importlib.import_module("public_tokenizers").path(TOKENIZER)
    with open(path, encoding="ascii") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    # an Arrow table needs no Python worker of its own kind on the executors
    read = pa.table({"b64": pa.array([a for a, _ in pairs], pa.string()), "rank": pa.array([int(b) for _, b in pairs], pa.int32())})
    return spark.createDataFrame(read).select(F.unbase64("b64").alias("piece"), "rank")


def _bucketed(entries: DataFrame, key: str, value: str, buckets: int) -> DataFrame:
    """One row: an array over buckets of maps key -> value."""
    slot = F.hash(key).bitwiseAND(buckets - 1)
    maps = entries.groupBy(slot.alias("slot")).agg(
        F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))
    kind = maps.schema["m"].dataType.simpleString()
    every = entries.sparkSession.range(buckets).select(F.col("id").cast("int").alias("slot"))
    whole = every.join(maps, "slot", "left").select("slot", F.coalesce("m", F.expr(f"cast(map() as {kind})")).alias("m"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.map_entries("m").alias("e")))),
                                 lambda s: F.map_from_entries(s["e"])).alias("maps"))


class Constants:
    """One-row tables whose value becomes a literal of the plans built inside
    the ``with`` block; their session variables are dropped at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []

    def __enter__(self) -> Constants:
        return self

    def add(self, one: DataFrame) -> Column:
        name = f"const_{uuid.uuid4().hex}"
        one.createOrReplaceTempView(name)
        self.spark.sql(f"DECLARE VARIABLE {name} {one.schema[0].dataType.simpleString()}")
        self.names.append(name)
        self.spark.sql(f"SET VARIABLE {name} = (SELECT * FROM {name})")
        self.spark.catalog.dropTempView(name)
        return F.expr(f"system.session.{name}")

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")


def _lookup(maps: Column, key: Column, buckets: int) -> Column:
    return F.try_element_at(F.get(maps, F.hash(key).bitwiseAND(buckets - 1)), key)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_word(word: Column, rank_of) -> Column:
    """Ids of one word (binary): pieces start as single bytes, with the rank
    of each adjacent pair; every step merges the best pair and looks up the
    two pairs that changed."""
    none = F.array().cast("array<int>")
    pair = lambda a, b: F.coalesce(rank_of(F.concat(a, b)), F.lit(NO_RANK))

    def step(acc: Column, _: Column) -> Column:
        return _let(F.array_min(acc["ranks"]), lambda best: F.when(best >= NO_RANK, acc).otherwise(
            _let(F.array_position(acc["ranks"], best).cast("int"), lambda at: merge(acc["pieces"], acc["ranks"], at))))

    def merge(p: Column, r: Column, at: Column) -> Column:
        def joined(made: Column) -> Column:
            left = F.when(at > 1, F.array(pair(F.get(p, at - 2), made))).otherwise(none)
            right = F.when(at + 1 < F.size(p), pair(made, F.get(p, at + 1))).otherwise(F.lit(NO_RANK))
            return F.struct(
                F.concat(F.slice(p, F.lit(1), at - 1), F.array(made), F.slice(p, at + 2, F.size(p))).alias("pieces"),
                F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, F.array(right),
                         F.slice(r, at + 2, F.size(r))).alias("ranks"))
        return _let(F.concat(F.get(p, at - 1), F.get(p, at)), joined)

    def whole(n: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
        ranks = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(
            i < n, F.coalesce(rank_of(F.substring(word, i, F.lit(2))), F.lit(NO_RANK))).otherwise(F.lit(NO_RANK)))
        steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(none)
        return F.aggregate(steps, F.struct(pieces.alias("pieces"), ranks.alias("ranks")), step,
                           lambda acc: F.transform(acc["pieces"], rank_of))

    # a word that is a piece itself is its own id
    return _let(rank_of(word), lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(
        _let(F.octet_length(word), whole)))


def _spans() -> list[tuple[int, int]]:
    """Start and end of every substring of two bytes or more, by its end."""
    return [(i, j) for j in range(2, SHORT_BYTES + 1) for i in range(j - 1)]


def fold_short_word(word: Column, ranks_of: Ranks) -> Column:
    """Ids of a word of at most ``SHORT_BYTES`` bytes (binary) where ranks grow
    with every merge: a fold over the word's ranked merges, lowest rank first,
    then leftmost. A merge happens if its ends are boundaries and exactly one
    boundary lies between; that one goes. A merge is a number: the rank in its
    cell and the number of its span. The state is one too: the bits of the
    places that are no boundary, then (23 bits) of those that are."""
    n = F.octet_length(word)
    spans = F.slice(F.expr(f"sequence(0, {len(_spans()) - 1})"), F.lit(1), F.shiftright(n * (n - 1), 1))
    starts = long_array([i + 1 for i, _ in _spans()]).cast("array<int>")
    sizes = long_array([j - i for i, j in _spans()]).cast("array<int>")
    bits = long_array([(1 << i | 1 << j) << 23 | (1 << j) - (2 << i) for i, j in _spans()])
    string = lambda k: F.substring(word, F.get(starts, k), F.get(sizes, k))
    span = lambda m: m.bitwiseAND(255).cast("int")
    numbered = lambda rank, k: F.shiftleft(rank.cast("bigint"), 8) + k

    def merge(state: Column, m: Column) -> Column:
        met = state.bitwiseAND(F.get(bits, span(m)))
        # a cell's rank may be another string's, so the piece is compared where it matters
        fits = (met < 1 << 23) & (F.bit_count(met) == 1) & (F.get(ranks_of.by_rank, F.shiftright(m, 8).cast("int")) == string(span(m)))
        return F.when(fits, state + met * ((1 << 23) - 1)).otherwise(state)

    def pieces(state: Column) -> Column:
        return _let(F.filter(F.sequence(F.lit(0), n), lambda i: F.getbit(state, i) == 1), lambda at: ranks_of(F.transform(
            F.sequence(F.lit(1), F.size(at) - 1), lambda k: F.substring(
                word, F.get(at, k - 1) + 1, F.get(at, k) - F.get(at, k - 1)))))

    cell_of = lambda k: ranks_of.cell_of(string(k))
    merges = F.transform(F.filter(spans, lambda k: cell_of(k).isNotNull()), lambda k: numbered(cell_of(k), k))
    # where pieces share a cell the rank is looked up; NULL (no piece) merges nothing
    sure = F.transform(merges, lambda m: F.when(m >= 0, m).otherwise(numbered(ranks_of.rank_of(string(span(m))), span(m))))
    all_edges = F.call_function("shiftleft", F.lit(1).cast("bigint"), n + 1) - 1
    return _let(F.aggregate(F.sort_array(sure), all_edges, merge), pieces)


def _code(rank: Column) -> Column:
    """An id as one character (UTF-16, below the surrogates)."""
    return F.decode(F.unhex(F.lpad(F.hex(rank + 1), 4, "0")), "UTF-16BE")


def fold_long_word(word: Column, rank_of, pieces: Column) -> Column:
    """Ids of one long word (binary): the word is a string with a character
    per piece, and the merges are applied in the order of their ranks, each at
    all places at once, left to right. Where ranks grow with every merge (see
    ``ascending``) this is what joining the lowest pair step by step gives. A
    piece that is not in the word cannot be merged in it."""
    def merge(acc: Column, rank: Column) -> Column:
        piece = F.get(pieces, rank)
        cuts = F.sequence(F.lit(1), F.octet_length(piece) - 1)
        halves = F.transform(cuts, lambda i: F.concat(
            _code(rank_of(F.substring(piece, F.lit(1), i))),
            _code(rank_of(F.substring(piece, i + 1, F.octet_length(piece))))))
        # two ways to make a piece are tried at each place, so the leftmost goes first
        quoted = F.transform(F.array_compact(halves), lambda h: F.concat(
            F.lit("\\x{"), F.hex(F.encode(F.substring(h, 1, 1), "UTF-16BE")), F.lit("}\\x{"),
            F.hex(F.encode(F.substring(h, 2, 1), "UTF-16BE")), F.lit("}")))
        return F.when(F.size(quoted) > 0, F.regexp_replace(acc, F.array_join(quoted, "|"), _code(rank))).otherwise(acc)

    n = F.octet_length(word)
    single = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _code(rank_of(F.substring(word, i, F.lit(1))))), "")
    merges = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda r: (
        F.octet_length(F.get(pieces, r)) > 1) & F.contains(word, F.get(pieces, r)))
    coded = F.encode(F.aggregate(merges, single, merge), "UTF-16BE")
    return _let(coded, lambda c: F.transform(F.sequence(F.lit(0), F.shiftright(F.octet_length(c), 1) - 1), lambda i: (
        F.conv(F.hex(F.substring(c, i * 2 + 1, F.lit(2))), 16, 10).cast("int") - 1)))


def ascending(ranks: dict[bytes, int]) -> bool:
    """Whether merging the pieces of every piece in rank order ends in that
    piece. Then no merge makes a pair of a lower rank possible, in any word:
    such a pair would show in the piece that it makes."""
    for piece, own in ranks.items():
        n = len(piece)
        spans = sorted((r, i, j) for i in range(n) for j in range(i + 2, n + 1) if (r := ranks.get(piece[i:j])) is not None)
        edges = (1 << (n + 1)) - 1
        for rank, i, j in spans:
            inner = edges & ((1 << j) - (1 << (i + 1)))
            if rank <= own and edges >> i & 1 and edges >> j & 1 and inner and not inner & (inner - 1):
                edges ^= inner
        if n > 1 and edges != 1 | 1 << n:
            return False
    return True


class Ranks:
    """Ranks of strings of bytes. A string's cell, by its hash, holds the rank
    of the only piece there, -1 where pieces share it, NULL where there is
    none; the pieces of shared cells are in a map."""

    def __init__(self, constants: Constants, ranks: DataFrame):
        self.by_rank = constants.add(_by_rank(ranks))
        placed = ranks.withColumn("cell", _cell(F.col("piece")))
        taken = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank"))
        at, n, rank = np.array(taken.collect(), np.int64).reshape(-1, 3).T   # the tokenizer's, a fixed number
        held, empty = np.full(RANK_CELLS, -1, np.int32), np.ones(RANK_CELLS, bool)
        held[at[n == 1]], empty[at] = rank[n == 1], False
        cells = pa.ListArray.from_arrays([0, RANK_CELLS], pa.array(held, mask=empty))
        self.cells = constants.add(ranks.sparkSession.createDataFrame(pa.table({"cells": cells})))
        shared = placed.join(taken.filter("n > 1").select("cell"), "cell", "left_semi")
        self.maps = constants.add(_bucketed(shared, "piece", "rank", RANK_BUCKETS))

    def cell_of(self, string: Column) -> Column:
        return F.get(self.cells, _cell(string))

    def rank_of(self, string: Column) -> Column:
        """NULL where the string is no piece."""
        return _let(string, lambda s: F.when(F.get(self.by_rank, self.cell_of(s)) == s, self.cell_of(s)).when(
            self.cell_of(s) < 0, _lookup(self.maps, s, RANK_BUCKETS)))

    def __call__(self, strings: Column) -> Column:
        """The rank of each of an array's strings."""
        return F.transform(strings, self.rank_of)


def _cell(string: Column) -> Column:
    return F.hash(string).bitwiseAND(RANK_CELLS - 1)


def _rank_lookups(constants: Constants, ranks: DataFrame):
    """The rank of a string of bytes, and of an array's strings."""
    found = Ranks(constants, ranks)
    return found.rank_of, found


def word_ids(texts: DataFrame, text: str, of_word, cache_docs: int = CACHE_DOCS,
             cache_words: int = CACHE_WORDS) -> DataFrame:
    """(word, ids) of the distinct words of about ``cache_docs`` texts, taken
    by their hash. Beyond about ``cache_words`` words the most frequent stay:
    the least count kept is read off a histogram of the counts, and of its
    words a share by hash."""
    share = min(1.0, cache_docs / max(1, texts.count()))
    sample = texts.filter(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < int(share * (1 << 20)))
    words = sample.select(F.explode(words_expr(F.col(text), split_pattern())).alias("word"))
    counts = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
                         .filter(F.octet_length("word") <= CACHE_WORD_BYTES))
    levels = counts.groupBy(F.least("n", F.lit(1000)).alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, part, kept = 1001, 0.0, 0
    for level, words_at in sorted(levels, reverse=True):
        least, part = level, min(1.0, (cache_words - kept) / words_at)
        kept += words_at
        if kept >= cache_words:
            break
    drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(part * (1 << 20))
    level = F.least("n", F.lit(1000))
    frequent = counts.filter((level > least) | ((level == least) & drawn)).repartition("word")
    return frequent.select("word", of_word(F.col("word")).alias("ids"))


def _words(joined: pa.Array, apart: pa.Array) -> pa.ListArray:
    """The words of each text, from one string or, where that has the break
    in a word, from a list. What follows the last break is an empty word."""
    lists = pc.split_pattern(pc.fill_null(joined, ""), BREAK)
    if apart.null_count < len(apart):
        lists = pa.array([own if own is not None else whole for own, whole in
                          zip(apart.to_pylist(), lists.to_pylist(), strict=True)], lists.type)
    return lists


def _runs(joined: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of texts of ``RUN_BYTES`` bytes, one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(joined), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(joined):
        end = max(at + 1, int(np.searchsorted(size, done + RUN_BYTES, side="right")))
        yield at, end
        at, done = end, int(size[end - 1])


def _index_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run first its distinct words, a row each, then its documents
    with the index of every word (32-bit numbers)."""
    names = ["word", "at", "whole"]
    for batch in batches:
        whole, joined, apart = batch.columns
        for at, end in _runs(joined):
            lists = _words(joined.slice(at, end - at), apart.slice(at, end - at))
            coded = lists.flatten().dictionary_encode()
            n = len(coded.dictionary)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.nulls(n, pa.binary()), pa.nulls(n, whole.type)], names)
            offsets = 4 * np.cumsum(np.r_[0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)])
            places = pa.Array.from_buffers(pa.binary(), end - at, [
                None, pa.py_buffer(offsets.astype("<i4").tobytes()),
                pa.py_buffer(coded.indices.to_numpy().astype("<i4").tobytes())])
            del lists, coded        # workers stay for later tasks: what a run took goes back
            give_back()
            yield pa.RecordBatch.from_arrays([pa.nulls(end - at, pa.string()), places, own_copy(whole.slice(at, end - at))], names)
        del batch, whole, joined, apart
    give_back()


def _numbers(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 32-bit numbers of some binary cells, and the end of each cell."""
    _, ends, data = cells.buffers()
    at = np.frombuffer(ends, "<i4", len(cells) + 1, 4 * cells.offset)
    if at[0] == at[-1]:
        return np.empty(0, "<i4"), np.zeros(len(cells), np.int64)
    return np.frombuffer(data, "<i4", (at[-1] - at[0]) // 4, at[0]), (at[1:].astype(np.int64) - at[0]) // 4


def _place_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the ids of their words, from the rows of
    ``_index_words`` once these have the ids of the words."""
    held: list[pa.Array] = []
    known: pa.Array | None = None
    for batch in batches:
        is_word = pc.is_null(batch.column(1)).to_numpy(zero_copy_only=False)
        edges = np.r_[0, np.flatnonzero(is_word[1:] != is_word[:-1]) + 1, len(is_word)]
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if is_word[i]:
                if known is not None:
                    held, known = [], None
                held.append(batch.column(0).slice(i, j - i))
                continue
            if known is None:
                known = pa.concat_arrays(held)
            places, ends = _numbers(batch.column(1).slice(i, j - i))
            found = known.take(pa.array(places))
            size = np.r_[0, np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))]
            ids = pa.ListArray.from_arrays(size[np.r_[0, ends]].astype(np.int32), found.flatten())
            yield pa.RecordBatch.from_arrays([own_copy(batch.column(2).slice(i, j - i)), ids], ["whole", "ids"])
            del places, found, ids
        del batch
        give_back()
    del held, known
    give_back()


def encode(docs: DataFrame, text: str, ids: str, ranks: DataFrame, cache_docs: int = CACHE_DOCS,
           carry: Sequence[str] | None = None) -> DataFrame:
    """Add the array of token ids of every text. Only the columns ``carry``
    (default: all) travel with the words and stay."""
    spark = docs.sparkSession
    by_piece = {bytes(r["piece"]): r["rank"] for r in ranks.collect()}   # the tokenizer's, a fixed number
    with Constants(spark) as constants:
        rank_of, ranks_of = _rank_lookups(constants, ranks)
        in_order = ascending(by_piece)

        def of_word(word: Column) -> Column:
            return _let(word.cast("binary"), of_binary)

        def of_binary(binary: Column) -> Column:
            size = F.octet_length(binary)
            ids = F.when(size == 0, F.array().cast("array<int>"))   # the one word of an empty text
            if in_order:
                ids = ids.when(size <= SHORT_BYTES, fold_short_word(binary, ranks_of)) \
                    .when(size > LONG_BYTES, fold_long_word(binary, rank_of, ranks_of.by_rank))
            return ids.otherwise(fold_word(binary, rank_of))

        cache = materialize(word_ids(docs, text, of_word, cache_docs)).withColumnRenamed("ids", "known")
        whole = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("whole")
        string = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        clean = ~F.contains(string, F.lit(BREAK))
        # every character is in some match, so a break after each match is enough
        rows = docs.select(whole, F.when(clean, F.regexp_replace(string, split_pattern(), f"$0{BREAK}")).alias("joined"),
                           F.when(~clean, words_expr(string, split_pattern())).alias("apart"))
        kind = rows.schema["whole"]
        ints = ArrayType(IntegerType())
        indexed = rows.mapInArrow(_index_words, StructType([
            StructField("word", StringType()), StructField("at", BinaryType()), StructField("whole", kind.dataType)]))
        # rows keep their order: a broadcast join streams this side
        met = indexed.join(F.broadcast(cache), "word", "left").select(
            F.when(F.col("word").isNotNull(), F.coalesce("known", of_word(F.col("word")))).alias("ids"), "at", "whole")
        placed = met.mapInArrow(_place_ids, StructType([StructField("whole", kind.dataType), StructField("ids", ints)]))
        return placed.select("whole.*", F.col("ids").alias(ids))


def _by_rank(ranks: DataFrame) -> DataFrame:
    """One row: the pieces by rank, empty where a rank has none."""
    top = ranks.agg(F.max("rank")).first()[0]
    every = ranks.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("rank"))
    listed = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("piece", F.lit(b"")).alias("piece"))))
    return every.join(ranks, "rank", "left").agg(F.transform(listed, lambda s: s["piece"]).alias("pieces"))


def decode(rows: DataFrame, ids: str, out: str, ranks: DataFrame) -> DataFrame:
    """Add the bytes of every id array: the pieces, concatenated. An id
    without a piece gives NULL."""
    top, n = ranks.agg(F.max("rank"), F.count_distinct("rank")).first()
    every = ranks.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("rank"))
    listed = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("piece", F.lit(b"")).alias("piece"))))
    with Constants(rows.sparkSession) as constants:
        # binary to string and back keeps the bytes; array_join appends them once
        pieces = constants.add(every.join(ranks, "rank", "left").agg(
            F.transform(listed, lambda s: s["piece"].cast("string")).alias("pieces")))
        joined = F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "").cast("binary")
        known = F.coalesce((F.array_min(ids) >= 0) & (F.array_max(ids) <= top), F.lit(True))
        if n <= top:   # some ids below the largest have no piece
            known = known & ~F.exists(ids, lambda i: F.get(pieces, i) == "")
        return rows.withColumn(out, F.when(known, joined))


def digest(rows: DataFrame, ids: str, decoded: str, *columns: str) -> DataFrame:
    return rows.select(
        *columns, F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"))


def round_trip(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """doc_id, ids and the decoded bytes of every text."""
    encoded = encode(docs, "text", "ids", ranks, carry=["doc_id"])
    return decode(encoded, "ids", "decoded", ranks)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(round_trip(table(spark, sf_dir, "documents"), read_ranks(spark)), "ids", "decoded", "doc_id")
