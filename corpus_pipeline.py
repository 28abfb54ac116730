"""A training corpus from raw documents, stage by stage.

``STAGES`` are (name, function) pairs; each function takes (spark, docs,
sf_dir) and returns a DataFrame. ``run`` applies them to the documents table
and writes every stage's rows as Parquet below the shared checkpoint folder,
so that a lost executor costs one stage's tasks at most. All stages but the
last keep the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayflow.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from assayflow.llm.common import materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain does not reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, and digests of the ids and the decoded bytes."""
    coded = bpe.round_trip(docs, bpe.read_ranks(spark))
    return bpe.digest(coded, "ids", "decoded", "doc_id", "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_test_items),
    ("byte_bpe", encode_texts),
]

#: The chain's classifier and the near duplicates have no SQL form; the tests
#: hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
