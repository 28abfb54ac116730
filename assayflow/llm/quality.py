"""Quality by histogram gradient-boosted trees (operator 8).

Sixteen statistics describe a document: lengths, shares of symbols, capitals
and digits, repetition of words and lines, sentence marks. Trees are grown on
histograms: every statistic is cut into at most ``BINS`` bins by its quantiles,
and a split is read off the sums of gradients per bin. All trees are stored as
flat arrays (feature, threshold, leaf value by node number), so a batch of
documents walks all trees at once, level by level, in numpy.

Fitting uses a bounded sample: about ``SAMPLE`` labelled documents, taken by
the hash of their id, none of the held-out quarter; the statistics are
computed on the executors and only their rows reach the driver.

Defined results: NULL and empty texts have all statistics 0 and are scored
like any other; each input row gives one row, repeated rows and NULL ids
included; NULL labels and labels without a document are ignored; with no
labels, or labels of one class, the score is a constant; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from assayflow.llm.common import held_out, table
from assayflow.llm.toxicity import sample_labels

SAMPLE = 20_000
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 64
MIN_HESSIAN, RIDGE = 2.0, 1.0
CUT = 0.7

_SYMBOL = re.compile(r"[^\w\s]")
_DIGIT = re.compile(r"\d")
_MARK = re.compile(r"[.!?]")
STATISTICS = ("log_chars", "log_words", "word_length", "distinct_words", "top_word", "capital_words", "title_words",
              "short_words", "symbols", "digits", "sentence_marks", "pipes", "log_lines", "line_words",
              "repeated_lines", "runs")


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    if not text:
        return [0.0] * len(STATISTICS)
    words, lines = text.split(), text.split("\n")
    n, chars = max(1, len(words)), len(text)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    return [
        float(np.log1p(chars)), float(np.log1p(len(words))), sum(map(len, words)) / n,
        len(counts) / n, top / n,
        sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n,
        sum(len(w) <= 3 for w in words) / n,
        len(_SYMBOL.findall(text)) / chars, len(_DIGIT.findall(text)) / chars,
        len(_MARK.findall(text)) / n, text.count("|") / n,
        float(np.log1p(len(lines))), len(words) / len(lines),
        1.0 - len(set(lines)) / len(lines),
        sum(a == b for a, b in zip(words, words[1:])) / n,
    ]


@dataclass
class Forest:
    """Trees as arrays of shape (trees, nodes); node i has children 2i + 1
    and 2i + 2, and a node that does not split sends everything left."""
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row."""
        row = np.arange(len(x))[:, None]
        tree = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        z = self.base + self.value[tree, node].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost ``TREES`` trees of ``DEPTH`` levels on the logistic loss."""
    nodes = (1 << (DEPTH + 1)) - 1
    feature = np.zeros((TREES, nodes), dtype=np.int64)
    threshold = np.full((TREES, nodes), np.inf)
    value = np.zeros((TREES, nodes))
    rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Forest(base, feature, threshold, value)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    z = np.full(len(y), base)
    for t in range(TREES):
        p = 1.0 / (1.0 + np.exp(-z))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), dtype=np.int64)
        for depth in range(DEPTH):
            first, width = (1 << depth) - 1, 1 << depth
            best = np.full(width, 1e-6)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                cell = (node - first) * (BINS + 1) + binned[:, f]
                g = np.bincount(cell, grad, width * (BINS + 1)).reshape(width, -1)
                h = np.bincount(cell, hess, width * (BINS + 1)).reshape(width, -1)
                gl, hl = g.cumsum(axis=1)[:, :len(cut)], h.cumsum(axis=1)[:, :len(cut)]
                gt, ht = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
                gain = gl**2 / (hl + RIDGE) + (gt - gl)**2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hl < MIN_HESSIAN) | (ht - hl < MIN_HESSIAN)] = 0.0
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best
                best[better] = gain[np.arange(width), at][better]
                feature[t, first:first + width][better] = f
                threshold[t, first:first + width][better] = cut[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        first = (1 << DEPTH) - 1
        g = np.bincount(node - first, grad, 1 << DEPTH)
        h = np.bincount(node - first, hess, 1 << DEPTH)
        value[t, first:] = RATE * g / (h + RIDGE)
        z += value[t, node]
    return Forest(base, feature, threshold, value)


@F.pandas_udf(ArrayType(DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return texts.map(statistics)


def fit_forest(docs: DataFrame, labels: DataFrame) -> Forest:
    """Fit on the sample of labelled documents."""
    sample = F.broadcast(sample_labels(labels, "quality", SAMPLE))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select(
        "doc_id", "label", _statistics("text").alias("x")).orderBy("doc_id").collect()
    return grow(np.array([r["x"] for r in rows]).reshape(len(rows), len(STATISTICS)),
                np.array([r["label"] for r in rows], dtype=float))


def scores(text: Column, forest: Forest, spark: SparkSession) -> Column:
    """Score of a text column."""
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))
        return pd.Series(shared.value.predict(x))

    return score(text)


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every input row."""
    forest = fit_forest(docs, labels)
    scored = docs.select("doc_id", scores(F.col("text"), forest, docs.sparkSession).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
