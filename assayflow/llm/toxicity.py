"""Toxicity by a classifier chain (operator 4).

Categories are predicted one after the other by linear (logistic) models over
the words of a text and their beginnings; each model also gets the
probabilities of the categories before it. While training, those probabilities are out of fold: a model fitted on the
other folds predicts them, so a later model sees the errors it will meet.

The last category is the label ``toxic``. The categories before it split the
toxic documents by the words they use (``CATEGORY_WORDS``, a parameter); they
are only targets of training and give the chain its intermediate steps.

Fitting uses a bounded sample: about ``SAMPLE`` labelled documents, taken by
the hash of their id, none of the held-out quarter. The ``VOCABULARY`` words
and beginnings most associated with the label in the sample are the features.

Defined results: NULL and empty texts have no words and get the chain's base
rate; each input row gives one row, repeated rows and NULL ids included;
labels that are NULL, without a document or contradicting (the largest counts)
do no harm; with no positive or no negative label the chain predicts the
constant rate; extra columns are ignored by the table and kept by the filter;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from assayflow.llm.common import give_back, held_out, materialize, table

WORD = re.compile(r"[^\W\d_]+")
JVM_WORD = r"\p{L}+"
#: Labelled documents used for fitting (about), features, and folds.
SAMPLE, VOCABULARY, FOLDS = 10_000, 600, 3
#: Lengths of the word beginnings among the features.
BEGINNINGS = (3, 4, 5, 6)
MIN_DOCS = 8
CUT = 0.5
#: Weight of a positive row against a negative one.
POSITIVE = 3.0

# Words that make the categories before the last.
CATEGORY_WORDS = {
    "insult": ("idiot", "moron", "clown", "loser", "stupid", "fool", "dumb"),
    "contempt": ("trash", "scum", "worthless", "pathetic", "disgusting", "garbage", "vermin"),
}
CATEGORIES = (*CATEGORY_WORDS, "toxic")


def features_of(text: str | None) -> set[str]:
    """Whole words (marked =) and beginnings (marked ^) of a text."""
    words = set(WORD.findall(text.lower())) if text else set()
    out = {"=" + w for w in words}
    for n in BEGINNINGS:
        out.update(["^" + w[:n] for w in words])
    return out


def _features(text: Column) -> Column:
    """The same in Spark."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(JVM_WORD), F.lit(0)))
    return F.array_distinct(F.flatten(F.array(
        F.transform(words, lambda w: F.concat(F.lit("="), w)),
        *[_beginnings(words, n) for n in BEGINNINGS])))


def _beginnings(words: Column, n: int) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit("^"), F.substring(w, 1, n)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 120) -> np.ndarray:
    """Weights (bias first) of a logistic regression by accelerated gradient
    steps; the constant rate where one class is absent."""
    n, d = x.shape
    rate = float(np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3))
    out = np.zeros(d + 1, dtype=np.float32)
    out[0] = np.log(rate / (1 - rate))
    if n == 0 or y.min() == y.max():
        return out
    # columns of equal spread, so that rare and common features learn alike
    spread = np.r_[1.0, 1.0 / np.maximum(x.std(axis=0), 0.02)].astype(np.float32)
    design = np.hstack([np.ones((n, 1)), x]).astype(np.float32) * spread
    flipped, y = np.ascontiguousarray(design.T), y.astype(np.float32)
    weight = np.where(y == 1, POSITIVE, 1.0).astype(np.float32)
    weight /= weight.sum()
    # the largest curvature, by power iteration
    v = np.ones(d + 1, dtype=np.float32)
    for _ in range(12):
        v /= np.linalg.norm(v)
        v = flipped @ (weight * (design @ v))
    top = float(np.linalg.norm(v))
    step = np.float32(1.0 / (0.3 * top + ridge))
    look, momentum = out.copy(), 1.0
    for _ in range(rounds):
        error = (weight * (_sigmoid(design @ look) - y)).astype(np.float32)
        after = look - step * (flipped @ error + np.float32(ridge) * look)
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        look = (after + np.float32((momentum - 1) / grown) * (after - out)).astype(np.float32)
        out, momentum = after.astype(np.float32), grown
    return out * spread


@dataclass
class Chain:
    """Vocabulary and the linear models of the categories, in order."""
    categories: Sequence[str]
    words: dict[str, int]
    models: list[np.ndarray] = field(default_factory=list)

    def rows(self, sets: Iterable[set[str]], n: int) -> np.ndarray:
        """Feature rows of ``n`` texts; takes one text's features at a time."""
        x = np.zeros((n, len(self.words)), dtype=np.float32)
        known = self.words.keys()
        for i, words in enumerate(sets):
            x[i, [self.words[w] for w in words & known]] = 1.0
        return x

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
        """One model per column of ``y``; ``fold`` numbers the rows' folds."""
        before = np.zeros((len(x), 0), dtype=np.float32)
        for c in range(y.shape[1]):
            now = np.hstack([x, before])
            self.models.append(fit_linear(now, y[:, c]))
            unseen = np.zeros(len(x), dtype=np.float32)
            for f in range(FOLDS):
                rest, own = fold != f, fold == f
                unseen[own] = _probability(fit_linear(now[rest], y[rest, c]), now[own])
            before = np.hstack([before, unseen[:, None]])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of all categories, each from those before it."""
        out = np.zeros((len(x), 0), dtype=np.float32)
        for model in self.models:
            out = np.hstack([out, _probability(model, np.hstack([x, out]))[:, None].astype(np.float32)])
        return out


def _probability(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _sigmoid(model[0] + x @ model[1:])


def sample_labels(labels: DataFrame, column: str, size: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of about ``size`` labelled documents by hash, none of
    them held out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, size / max(1, usable.count()))
    taken = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return taken.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))


def fit_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fit on the sample; the texts stay on the executors, the driver gets the
    vocabulary and the sampled rows' features (both bounded)."""
    sample = F.broadcast(sample_labels(labels, "toxic"))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select(
        "doc_id", "label", _features(F.col("text")).alias("words"))
    rows = materialize(rows)
    n, n_pos = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    # association: observed against expected positives, in standard deviations
    share = (n_pos + 1) / (n + 2)
    z = F.abs(F.col("pos") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    top = counts.filter(F.col("n") >= MIN_DOCS).orderBy(z.desc(), "word").limit(VOCABULARY).collect()
    chain = Chain(CATEGORIES, {r["word"]: i for i, r in enumerate(sorted(top, key=lambda r: r["word"]))})
    wanted = F.array(*[F.lit(w) for w in {*chain.words, *("=" + w for ws in CATEGORY_WORDS.values() for w in ws)}]) if top else F.array()
    got = rows.select("label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold"),
                      F.array_intersect("words", wanted).alias("words")).collect() if top else []
    if not got:
        chain.models = [np.zeros(1 + len(chain.words) + c) + 0.0 for c in range(len(CATEGORIES))]
        for m in chain.models:
            m[0] = -7.0
        return chain
    sets = [set(r["words"]) for r in got]
    toxic = np.array([r["label"] for r in got], dtype=float)
    y = np.stack([toxic * np.array([bool(s & {"=" + w for w in ws}) for s in sets]) for ws in CATEGORY_WORDS.values()] + [toxic], axis=1)
    return chain.fit(chain.rows(sets, len(sets)), y, np.array([r["fold"] for r in got]))


def probabilities(text: Column, chain: Chain, spark: SparkSession) -> Column:
    """Array of the categories' probabilities for a text column."""
    shared = spark.sparkContext.broadcast(chain)

    @F.pandas_udf(ArrayType(DoubleType()))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield pd.Series(list(own.predict(own.rows((features_of(t) for t in texts), len(texts))).astype(float)))
            del texts
            give_back()
        give_back()

    return predict(text)


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, one probability per category, toxic (boolean)."""
    chain = fit_chain(docs, labels)
    scored = docs.select("doc_id", probabilities(F.col("text"), chain, docs.sparkSession).alias("p"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        *[F.get("p", F.lit(i)).alias(f"p_{c}") for i, c in enumerate(CATEGORIES)],
        (F.get("p", F.lit(len(CATEGORIES) - 1)) >= CUT).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the chain does not reject, with all their columns;
    row by row, without a shuffle."""
    chain = fit_chain(docs, labels)
    last = F.get(probabilities(F.col("text"), chain, docs.sparkSession), F.lit(len(CATEGORIES) - 1))
    return docs.filter(last < CUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
