"""Benchmark decontamination with BM25 and block-max WAND (operator 3).

The test items are indexed: a posting (term, item) holds its BM25 weight,
divided by the score the item must reach, so every item has the threshold 1
(an item's own words as a query score ``1 / THRESHOLD``). Postings of a term
are ordered by item and cut into blocks with their maxima.

Every training passage is a query: windows of two strides over the whole
text, one stride apart, with a stride no shorter than the longest item, so an
item quoted anywhere lies whole in one window. For each query block-max WAND
walks the postings of its terms: the pivot is the first item whose terms can
reach the threshold by their global maxima; if the maxima of the blocks it
lies in cannot, the walk skips to the next block border; otherwise the item
is scored. All items at or above the threshold are retrieved. The walk is
given only the blocks where the maxima of all the window's terms together
reach the threshold; for most windows there is none.

A retrieved pair is verified: the item is its question (the leading words)
and its answer (the last quarter), and the document must hold a share of
``OVERLAP`` of both. A part's share is the largest of three: its five-word
shingles found anywhere in the text; its words met in order by the best
alignment of the whole item with the retrieved windows, where an edit costs
one word and not five shingles; and the part's own best alignment with the
text if that reaches ``WHOLE``. A pair is also verified if the alignment of the
whole item reaches ``WHOLE``, wherever the missing words are, so a quote may
lack its last words. Aligning takes time in proportion to item times windows.

The index is sent to the tasks in parts of at most ``PART_ITEMS`` items, each
with a bounded number of words; more items make more parts and passes over
the text, so what a task holds never grows with the benchmark. The number of
items, their mean length and every term's document frequency are counted over
all items beforehand, and the windows of an item follow from its own length (the
next power of two words, ``STRIDE`` at least; a part holds items of one such
length), so an item's retrieval does not depend on the items beside it. A text
of any length is walked ``WINDOWS`` windows at a time.

Defined results: NULL and empty texts match nothing; items without words, or
NULL, are no items; equal items are reported each; rows that repeat a doc_id
give one row per (doc_id, item_id), NULL ids included; extra columns are
ignored by the table and kept by the filter; empty tables give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from assayflow.llm.common import give_back, materialize, table

WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
#: An item is retrieved at this share of its own score.
THRESHOLD = 0.5
#: Share of the question and of the answer that a document must hold.
OVERLAP = 0.6
#: Share of a whole item, or of a part alone, that an alignment must reach.
WHOLE = 0.8
SHINGLE, ANSWER_SHARE = 5, 0.25
STRIDE, BLOCK = 64, 4
#: Windows of one text whose bounds are held at a time.
WINDOWS = 1024
#: Items in one part of the index (their words: bounded by ``PART_WORDS``).
PART_ITEMS, PART_WORDS = 4096, 1 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(words: list[str], width: int) -> list[tuple[str, ...]]:
    return [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]


def split_item(words: list[str]) -> tuple[list[str], list[str]]:
    """Question and answer of an item: its last quarter, one word at least."""
    cut = len(words) - max(1, int(len(words) * ANSWER_SHARE))
    return (words[:cut], words[cut:]) if cut else (words, words)


def aligned(item: np.ndarray, text: np.ndarray, cut: int) -> tuple[float, float, float]:
    """Best alignment of an item with a stretch of a text: 1 - edits / length,
    and the shares of the first ``cut`` words and of the others met in order."""
    at = np.arange(len(text) + 1)
    cost, met, first = (np.zeros(len(text) + 1, dtype=np.int64) for _ in range(3))
    for i, word in enumerate(item):
        same = text == word
        replaced, left_out = cost[:-1] + ~same, cost[1:] + 1
        step = (replaced < left_out) | ((replaced == left_out) & (met[:-1] + same >= met[1:]))
        cost = np.r_[cost[0] + 1, np.where(step, replaced, left_out)]
        met = np.r_[met[0], np.where(step, met[:-1] + same, met[1:])]
        first = np.r_[first[0], np.where(step, first[:-1] + (same if i < cut else 0), first[1:])]
        # words of the text between two words of the item
        gap = cost - at
        low = np.minimum.accumulate(gap)
        source = np.maximum.accumulate(np.where(gap == low, at, 0))
        cost, met, first = low + at, met[source], first[source]
    end = np.lexsort((-met, cost))[0]
    whole = 1 - cost[end] / len(item)
    return float(whole), float(first[end] / max(1, cut)), float((met[end] - first[end]) / max(1, len(item) - cut))


@dataclass
class Cursor:
    """A place in the postings of one query term."""
    term: int
    docs: list[int]
    weights: list[float]
    at: int = 0


def _advanced(cursors: list[Cursor], upto: int, target: int) -> list[Cursor]:
    """Move the first cursors to their first posting at or after target; those
    at their end go."""
    for c in cursors[:upto]:
        c.at = bisect_left(c.docs, target, c.at)
    return [c for c in cursors if c.at < len(c.docs)]


@dataclass
class Corpus:
    """Counts over all items: how many, their mean length, and the document
    frequency of each term of the part at hand."""
    items: int
    mean_length: float
    seen: dict[str, int]


def stride_of(n_words: int) -> int:
    """Stride of the windows in which an item of this length is searched."""
    return max(STRIDE, 1 << (n_words - 1).bit_length())


@dataclass
class Index:
    """Inverted index of one part of the items.

    Postings of term t are ``docs[start[t]:start[t + 1]]``, positions in
    ``items``, with their weights; ``block_max`` has the maxima per (term,
    block of items), ``term_max`` per term. Without ``corpus`` the items are
    all there are.
    """
    items: list[tuple[int, list[str]]]
    corpus: Corpus | None = None
    terms: dict[str, int] = field(default_factory=dict)
    stride: int = STRIDE

    def __post_init__(self) -> None:
        n = len(self.items)
        lengths = np.array([len(w) for _, w in self.items], dtype=float)
        self.stride = max(stride_of(len(w)) for _, w in self.items)
        bags = [Counter(w) for _, w in self.items]
        corpus = self.corpus or Corpus(n, lengths.mean(), Counter(t for bag in bags for t in bag))
        seen = {t: corpus.seen[t] for bag in bags for t in bag}
        self.terms = {t: i for i, t in enumerate(sorted(seen))}
        idf = {t: np.log(1 + (corpus.items - c + 0.5) / (c + 0.5)) for t, c in seen.items()}
        norm = K1 * (1 - B + B * lengths / corpus.mean_length)
        weights = [{t: idf[t] * c * (K1 + 1) / (c + norm[d]) for t, c in bag.items()} for d, bag in enumerate(bags)]
        own = [THRESHOLD * sum(w.values()) for w in weights]
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for d, w in enumerate(weights):
            for t, x in w.items():
                lists[self.terms[t]].append((d, x / own[d]))
        self.start = np.cumsum([0] + [len(x) for x in lists])
        self.docs = np.array([d for x in lists for d, _ in x], dtype=np.int64)
        self.weights = np.array([v for x in lists for _, v in x])
        self.term_max = np.array([max(v for _, v in x) for x in lists])
        self.n_blocks = (n + BLOCK - 1) // BLOCK
        at = np.repeat(np.arange(len(lists)), np.diff(self.start)) * self.n_blocks + self.docs // BLOCK
        keys, where = np.unique(at, return_inverse=True)
        top = np.zeros(len(keys))
        np.maximum.at(top, where, self.weights)
        self.block_terms, self.block_ids, self.block_max = keys // self.n_blocks, keys % self.n_blocks, top
        self.block_start = np.searchsorted(self.block_terms, np.arange(len(lists) + 1))
        # terms of many blocks have their maxima in rows, the others in lists
        spread = np.diff(self.block_start)
        common = np.nonzero(spread > max(2, self.n_blocks // 8))[0]
        self.row_of = np.full(len(lists), -1)
        self.row_of[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n_blocks), dtype=np.float32)
        dense = self.row_of[self.block_terms] >= 0
        self.rows[self.row_of[self.block_terms[dense]], self.block_ids[dense]] = self.block_max[dense]

    # ------------------------------------------------------------- queries
    def wand(self, query: np.ndarray, blocks: np.ndarray | None = None) -> list[tuple[int, float]]:
        """(item position, score) of all items with score 1 or more in the
        given blocks (default: all); ``query`` has distinct term numbers."""
        cursors = self._cursors(query, blocks)
        found = []
        while cursors:
            cursors.sort(key=lambda c: c.docs[c.at])
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += self.term_max[c.term]
                if bound >= 1.0 - 1e-9:
                    pivot = k
                    break
            if pivot is None:
                return found
            doc = cursors[pivot].docs[cursors[pivot].at]
            while pivot + 1 < len(cursors) and cursors[pivot + 1].docs[cursors[pivot + 1].at] == doc:
                pivot += 1
            block = doc // BLOCK
            if sum(self._block_max(c.term, block) for c in cursors[:pivot + 1]) < 1.0 - 1e-9:
                # no item up to the block's end, or to the next cursor, can do
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1].docs[cursors[pivot + 1].at])
                cursors = _advanced(cursors, pivot + 1, max(target, doc + 1))
            elif cursors[0].docs[cursors[0].at] == doc:
                score = sum(c.weights[c.at] for c in cursors[:pivot + 1])
                if score >= 1.0 - 1e-9:
                    found.append((doc, score))
                cursors = _advanced(cursors, pivot + 1, doc + 1)
            else:
                cursors = _advanced(cursors, pivot, doc)
        return found

    def _cursors(self, query: np.ndarray, blocks: np.ndarray | None) -> list[Cursor]:
        out = []
        size = self.start[query + 1] - self.start[query]
        posting = np.repeat(self.start[query] - np.cumsum(size) + size, size) + np.arange(size.sum())
        term = np.repeat(query, size)
        if blocks is not None:
            inside = np.isin(self.docs[posting] // BLOCK, blocks)
            posting, term = posting[inside], term[inside]
        begin = np.r_[0, np.nonzero(np.diff(term))[0] + 1, len(term)] if len(term) else [0]
        for lo, hi in zip(begin[:-1], begin[1:]):
            out.append(Cursor(int(term[lo]), self.docs[posting[lo:hi]].tolist(), self.weights[posting[lo:hi]].tolist()))
        return out

    def _block_max(self, t: int, block: int) -> float:
        lo, hi = self.block_start[t], self.block_start[t + 1]
        at = lo + int(np.searchsorted(self.block_ids[lo:hi], block))
        return float(self.block_max[at]) if at < hi and self.block_ids[at] == block else 0.0

    def term_numbers(self, words: list[str]) -> np.ndarray:
        """Term numbers of a text's words (-1: in no item)."""
        return np.fromiter((self.terms.get(w, -1) for w in words), dtype=np.int64, count=len(words))

    def passages(self, words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each window that can reach the threshold in some block, its distinct
        terms and those blocks: sums of block maxima over the terms."""
        n_windows = max(1, (len(words) - 1) // self.stride)
        terms = self.term_numbers(words)
        for begin in range(0, n_windows, WINDOWS):
            some = min(WINDOWS, n_windows - begin)
            stretch = terms[begin * self.stride:(begin + some + 1) * self.stride]
            for i, query, blocks in self._stretch_passages(stretch, some):
                yield begin + i, query, blocks

    def _stretch_passages(self, terms: np.ndarray, n_windows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        place = np.nonzero(terms >= 0)[0]
        known, part = terms[place], place // self.stride
        # a word is in the window that starts with its stride and the one before
        first, second = part < n_windows, part > 0
        n = len(self.terms)
        pairs = np.unique(np.concatenate([part[first] * n + known[first], (part[second] - 1) * n + known[second]]))
        of, t = pairs // n, pairs % n
        row = self.row_of[t]
        bound = np.zeros((n_windows, self.n_blocks), dtype=np.float32)
        dense = row >= 0
        if dense.any():
            windows, begin = np.unique(of[dense], return_index=True)
            bound[windows] = np.add.reduceat(self.rows[row[dense]], begin, axis=0)
        of_rare, rare = of[~dense], t[~dense]
        size = self.block_start[rare + 1] - self.block_start[rare]
        posting = np.repeat(self.block_start[rare] - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(of_rare, size) * self.n_blocks + self.block_ids[posting]
        bound += np.bincount(cell, weights=self.block_max[posting], minlength=bound.size).reshape(bound.shape)
        # single precision sums: a margin keeps the bound on the safe side
        for i in np.nonzero((bound >= 1.0 - 1e-3).any(axis=1))[0]:
            yield int(i), t[of == i], np.nonzero(bound[i] >= 1.0 - 1e-3)[0]

    def _shares(self, item_words: list[str], text: np.ndarray, windows: list[int],
                shares: list[float]) -> tuple[float, float, float]:
        """Share of the whole item by its alignment with the windows, and the
        shares of question and answer, which are ``shares`` by shingles."""
        item = self.term_numbers(item_words)
        question, answer = shares
        whole, cut, margin = 0.0, len(split_item(item_words)[0]) % len(item), len(item) // 2
        low = 0
        for k, window in enumerate(windows):
            if k + 1 < len(windows) and windows[k + 1] <= window + 2:
                continue                                # one stretch with the next window
            begin, end = windows[low] * self.stride - margin, (window + 2) * self.stride + margin
            stretch, low = text[max(0, begin):end], k + 1
            # words in common bound an alignment from above; one that reaches
            # WHOLE holds OVERLAP of the question
            asked = item[:cut or len(item)]
            held = Counter(stretch[stretch >= 0].tolist())
            common = sum((Counter(asked.tolist()) & held).values())
            if max(question, answer) >= OVERLAP or common >= OVERLAP * len(asked):
                w, q, a = aligned(item, stretch, cut)
                whole, question, answer = max(whole, w), max(question, q if cut else a), max(answer, a)
        if whole < WHOLE and min(question, answer) < OVERLAP <= max(question, answer) and cut:
            if question < OVERLAP:
                own = aligned(item[:cut], text, cut)[0]
                question = own if own >= WHOLE else question
            else:
                own = aligned(item[cut:], text, len(item) - cut)[0]
                answer = own if own >= WHOLE else answer
        return whole, question, answer

    def matches(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question overlap, answer overlap) of the verified
        items of one text."""
        words = words_of(text)
        best: dict[int, float] = {}
        where: dict[int, list[int]] = {}
        if words:
            for window, query, blocks in self.passages(words):
                for d, score in self.wand(query, blocks):
                    best[d] = max(best.get(d, 0.0), score)
                    where.setdefault(d, []).append(window)
        out, held = [], {}
        terms = self.term_numbers(words) if best else None
        for d, score in sorted(best.items()):
            item, item_words = self.items[d]
            share = []
            for part in split_item(item_words):
                width = min(SHINGLE, len(part))
                if width not in held:
                    held[width] = set(grams(words, width))
                own = grams(part, width)
                share.append(sum(g in held[width] for g in own) / len(own))
            whole, *share = self._shares(item_words, terms, where[d], share)
            if min(share) >= OVERLAP or whole >= WHOLE:
                out.append((item, score, *share))
        return out


@F.pandas_udf(ArrayType(StringType()))
def _words_column(texts: pd.Series) -> pd.Series:
    return texts.map(words_of)


def counted_items(benchmark: DataFrame) -> DataFrame:
    """item_id, words, stride and, for each distinct word, its document
    frequency over all items: a table of a row per item that has words."""
    items = materialize(
        benchmark.filter("text is not null").select("item_id", "text", _words_column("text").alias("words"))
        .filter(F.size("words") > 0).withColumn("row", F.monotonically_increasing_id()))
    each = items.select("row", F.explode(F.array_distinct("words")).alias("word"))
    seen = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    terms = each.join(seen, "word").groupBy("row").agg(F.collect_list(F.struct("word", "n")).alias("seen"))
    size = F.size("words")
    power = F.call_function("shiftleft", F.lit(1), F.length(F.bin((size - 1).cast("bigint"))))
    stride = F.when(size <= STRIDE, F.lit(STRIDE)).otherwise(power)
    return materialize(items.join(terms, "row").select("item_id", "text", "words", stride.alias("stride"), "seen"))


def index_parts(benchmark: DataFrame, part_items: int = PART_ITEMS) -> Iterator[Index]:
    """Indexes over the items, part by part in the order of stride and
    item_id; the driver holds one part at a time."""
    table_of_items = counted_items(benchmark)
    n_items, mean_length = table_of_items.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    items: list[tuple[int, list[str]]] = []
    seen: dict[str, int] = {}
    size, stride = 0, None
    for r in table_of_items.orderBy("stride", "item_id", "text").toLocalIterator():
        words = r["words"]
        if items and (len(items) == part_items or size + len(words) > PART_WORDS or r["stride"] != stride):
            yield Index(items, Corpus(n_items, mean_length, seen))
            items, seen, size = [], {}, 0
        items.append((r["item_id"], words))
        seen.update((t["word"], t["n"]) for t in r["seen"])
        size, stride = size + len(words), r["stride"]
    if items:
        yield Index(items, Corpus(n_items, mean_length, seen))


def _matches_of(index: Index, docs: DataFrame) -> DataFrame:
    """Verified pairs of one part of the index."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            hits = [(i, *m) for i, text in zip(frame["doc_id"], frame["text"]) for m in own.matches(text)]
            yield pd.DataFrame(hits, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), "text").mapInPandas(
        search, f"doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double")


def contaminated(docs: DataFrame, benchmark: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """One row per (doc_id, item_id): score (in units of the threshold), the
    shares of the question and of the answer that the text holds."""
    parts = [_matches_of(index, docs) for index in index_parts(benchmark, part_items)]
    if not parts:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double")
    pairs = reduce(DataFrame.unionByName, parts)
    return pairs.groupBy("doc_id", "item_id").agg(
        F.round(F.max("score"), 6).alias("score"), F.max("question_overlap").alias("question_overlap"),
        F.max("answer_overlap").alias("answer_overlap"))


def _clean(text: Column, index: Index, spark: SparkSession) -> Column:
    """Whether a text holds no verified item of one part of the index."""
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        own = shared.value
        out = pd.Series([not own.matches(t) for t in texts], dtype=bool)
        give_back()
        return out

    return clean(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verified test item, with all their columns;
    row by row, without a shuffle."""
    for index in index_parts(benchmark):
        docs = docs.filter(_clean(F.col("text"), index, docs.sparkSession))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
