"""Queries of the training-data operators and the SQL of those that SQL can
express (DuckDB, over the same tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayflow.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    language,
    licenses,
    merkle,
    near_dedup,
    pii,
    quality,
    sharding,
    token_shards,
    toxicity,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_bm25_decontamination": decontaminate.query,
    "op4_toxicity_chain": toxicity.query,
    "op5_language_backoff": language.query,
    "op6_byte_bpe": bpe.query,
    "op7_hilbert_sharding": sharding.query,
    "op8_quality_trees": quality.query,
    "op9_weak_pii": pii.query,
    "op10_order_minhash": near_dedup.query,
    "op11_merkle_manifest": merkle.query,
    "op12_qdwh_whitening": whitening.query,
    "op13_repair_token_shards": token_shards.query,
}

ORACLE: dict[str, str] = {
    "op1_license_scan": licenses.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op7_hilbert_sharding": sharding.SQL,
    "op11_merkle_manifest": merkle.SQL,
}


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline


def queries_map() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_map() -> dict[str, str]:
    return dict(ORACLE)
