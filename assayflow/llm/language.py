"""Language identification by word-first backoff (operator 5).

A known word scores its log frequency in every language. An unknown word
falls back to its character n-grams (with a mark at both ends), the longest
first: the n-grams of the largest length of which any is known give the mean
of their log frequencies; else one shorter is tried, down to single letters.
A text's score per language is the sum over its words; the largest wins, ties
go to the first language in order.

A word is a letter with the letters and combining marks after it, in learning,
in predicting and in the test for a letter alike.

Learning reads documents with a language outside the held-out quarter, about
``TRAIN_DOCS`` of them shared evenly among the languages (at least
``LEAST_DOCS`` each, or all there are), taken by the hash of their id. Spark
counts words and n-grams; of every language the ``KNOWN_WORDS`` and, of each
length, ``KNOWN_GRAMS`` most frequent are known, again shared evenly with at
least ``LEAST_KEYS`` each, equal counts in the order of their hash. So no
language and no level of frequency is left out, and what is broadcast grows
with the number of languages alone: a known key holds an entry per language it
occurs in.

Defined results: NULL texts and texts without a letter are ``und`` with score
0; without any learned language all are ``und``; each input row gives one
row, repeated rows and NULL ids included; equal scores go to the first
language; texts and words of any length are read whole, in time that grows with
their length; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from assayflow.llm.common import held_out, materialize, table

PATTERN = r"\p{L}[\p{L}\p{M}]*"
WORD = regex.compile(PATTERN)
ASCII_WORD = re.compile("[a-z]+")
TRAIN_DOCS, LEAST_DOCS = 40_000, 100
KNOWN_WORDS, KNOWN_GRAMS, LEAST_KEYS = 120_000, 60_000, 200
GRAM_SIZES = (4, 3, 2, 1)
EDGE = "_"
SMOOTH = 0.1
#: Unknown words, and numbers in their scores, that a task remembers.
REMEMBERED, REMEMBERED_SCORES = 200_000, 4_000_000


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text."""
    low = (text or "").lower()
    return (ASCII_WORD if low.isascii() else WORD).findall(low)


class Frequencies:
    """Log frequencies of keys per language: what a key that is not seen has,
    and what each (key, language) that is seen has above it."""

    def __init__(self, rows: Sequence[tuple[str, str, int]], languages: Sequence[str]):
        at = {lang: i for i, lang in enumerate(languages)}
        rows = sorted((key, at[lang], n) for key, lang, n in rows)
        keys = sorted({key for key, _, _ in rows})
        self.index = {key: i for i, key in enumerate(keys)}
        self.language = np.array([lang for _, lang, _ in rows], dtype=np.int64)
        n = np.array([n for _, _, n in rows], dtype=np.float64)
        self.gain = np.log1p(n / SMOOTH)
        held = np.bincount(np.array([self.index[key] for key, _, _ in rows], dtype=np.int64), minlength=len(keys))
        self.first = np.concatenate([[0], np.cumsum(held)]).astype(np.int64)
        totals = np.bincount(self.language, n, len(languages)) + SMOOTH * len(keys)
        self.unseen = np.log(SMOOTH / np.maximum(totals, SMOOTH))

    def total(self, found: Sequence[int]) -> np.ndarray:
        """Sum of the log frequencies of keys, per language."""
        found = np.asarray(found, dtype=np.int64)
        size = self.first[found + 1] - self.first[found]
        cells = np.repeat(self.first[found] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        gains = np.bincount(self.language[cells], self.gain[cells], len(self.unseen))
        return len(found) * self.unseen + gains


@dataclass
class Model:
    """Log frequencies of the known words and, by length, n-grams."""
    languages: Sequence[str]
    words: Frequencies
    grams: dict[int, Frequencies]
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    def backoff(self, word: str) -> np.ndarray:
        """Scores of an unknown word."""
        marked = EDGE + word + EDGE
        for size in GRAM_SIZES:
            known = self.grams[size].index
            found = [known[g] for i in range(len(marked) - size + 1) if (g := marked[i:i + size]) in known]
            if found:
                return self.grams[size].total(found) / len(found)
        return np.zeros(len(self.languages))

    def score(self, text: str | None) -> tuple[str, float]:
        """(language, probability) of a text."""
        words = words_of(text)
        if not words or not self.languages:
            return "und", 0.0
        found, total = [], np.zeros(len(self.languages))
        for w in words:
            at = self.words.index.get(w)
            if at is not None:
                found.append(at)
                continue
            known = self.seen.get(w)
            if known is None:
                if len(self.seen) >= min(REMEMBERED, REMEMBERED_SCORES // len(self.languages)):
                    self.seen.clear()
                known = self.seen[w] = self.backoff(w)
            total += known
        total += self.words.total(found)
        best = int(total.argmax())
        return self.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def _frequent(counts: DataFrame, most: int) -> list[tuple[str, str, int]]:
    """(key, lang, n) rows of the ``most`` most frequent keys of any language."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.xxhash64("key"), "key")
    kept = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    rows = counts.join(kept.select("key").distinct(), "key")
    return [(r["key"], r["lang"], r["n"]) for r in rows.select("key", "lang", "n").collect()]


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from text and lang of documents that are not held out."""
    usable = docs.select("doc_id", "text", "lang").filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = materialize(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    groups = max(1, sizes.count())
    share = F.least(F.lit(1.0), F.lit(float(max(LEAST_DOCS, train_docs // groups))) / F.col("rows"))
    sample = usable.join(sizes, "lang").filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share * float(1 << 40))
    words = sample.select("lang", F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit(PATTERN), F.lit(0))).alias("key"))
    counts = materialize(words.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n")))
    marked = F.concat(F.lit(EDGE), F.col("key"), F.lit(EDGE))
    known = _frequent(counts, max(LEAST_KEYS, KNOWN_WORDS // groups))
    languages = sorted({lang for _, lang, _ in known})
    grams = {}
    for size in GRAM_SIZES:
        # a look ahead takes the n-gram, one letter is consumed
        each = F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))
        sums = counts.select("lang", "n", F.explode(each).alias("key")).groupBy("lang", "key").agg(F.sum("n").alias("n"))
        grams[size] = Frequencies(_frequent(materialize(sums), max(LEAST_KEYS, KNOWN_GRAMS // groups)), languages)
    return Model(languages, Frequencies(known, languages), grams)


def predictions(text: Column, model: Model, spark: SparkSession) -> Column:
    """Struct (lang_pred, score) of a text column."""
    shared = spark.sparkContext.broadcast(model)
    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    @F.pandas_udf(kind)
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        return pd.DataFrame([own.score(t) for t in texts], columns=["lang_pred", "score"])

    return predict(text)


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every input row."""
    model = learn(docs)
    scored = docs.select("doc_id", predictions(F.col("text"), model, docs.sparkSession).alias("p"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_table(table(spark, sf_dir, "documents"))
