"""Every operator on NULLs, repeats, long texts, clashing columns and empty
tables; the expected values are the docstrings' defined results."""

import corpus_pipeline
from assayflow.llm import (
    bpe, decontaminate, exact_dedup, language, licenses, near_dedup, pii, quality, sharding, toxicity,
)

N = 13


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows if r[key] is not None}


def test_licenses(edge, empty):
    rows = licenses.label_table(edge).collect()
    assert len(rows) == N and licenses.label_table(empty).count() == 0
    got = by_id(rows)
    assert (got[8].labels, got[8].n_base, got[8].first_word, got[8].score) == ("mit", 1, 1, 1.0)
    assert (got[4].n_words, got[4].labels, got[4].first_word, got[4].score) == (0, "", None, 0.0)
    assert got[6].n_words == 6001


def test_exact_dedup(edge, empty):
    rows = exact_dedup.dedup_table(edge).collect()
    assert len(rows) == N and exact_dedup.dedup_table(empty).count() == 0
    copies = [r for r in rows if r.doc_id in (1, 2, 9)]
    assert {r.keep_id for r in copies} == {1} and {r.group_size for r in copies} == {4}
    assert sum(r.kept for r in copies) == 1
    blank = [r for r in rows if r.group_size == 4 and r.keep_id == 7]   # "  \t\n" has the most code points
    assert len(blank) == 4 and sum(r.kept for r in blank) == 1
    kept = exact_dedup.drop_duplicates(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 6, 7, 8, 10]
    assert exact_dedup.drop_duplicates(empty).count() == 0


def test_decontamination(edge, empty, benchmark):
    rows = decontaminate.contaminated(edge, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(d, i) for d in (1, 2, 9) for i in (1, 5)} | {(3, 1), (3, 5)}
    clean = decontaminate.drop_contaminated(edge, benchmark)
    assert clean.columns == edge.columns and clean.count() == N - 5
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    assert decontaminate.contaminated(edge, benchmark.limit(0)).count() == 0


def test_toxicity(edge, empty, labels):
    rows = toxicity.toxicity_table(edge, labels).collect()
    assert len(rows) == N and all(0 <= r.p_toxic <= 1 for r in rows)
    assert toxicity.toxicity_table(empty, labels).count() == 0
    assert toxicity.toxicity_table(edge, labels.limit(0)).filter("toxic").count() == 0
    assert toxicity.drop_toxic(edge, labels.limit(0)).columns == edge.columns


def test_language(edge, empty):
    got = by_id(language.language_table(edge).collect())
    assert got[4].lang_pred == got[5].lang_pred == got[7].lang_pred == "und" and got[4].score == 0.0
    assert got[1].lang_pred == "en" and 0 < got[1].score <= 1
    assert language.language_table(empty).count() == 0


def test_bpe(spark, edge, empty):
    ranks = bpe.read_ranks(spark)
    rows = bpe.round_trip(edge, ranks).collect()
    assert len(rows) == N
    got = by_id(rows)
    assert got[4].ids == [] and bytes(got[4].decoded) == b""
    texts = by_id(edge.select("doc_id", "text").collect())
    assert all(bytes(got[i].decoded).decode() == (texts[i].text or "") for i in got)
    assert bpe.round_trip(empty, ranks).count() == 0


def test_sharding(edge, empty):
    rows = sharding.shard_table(edge, 4).collect()
    counts = [sum(r.shard == s for r in rows) for s in range(4)]
    assert len(rows) == N and max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert by_id(rows)[4].size == 8 and by_id(rows)[4].text_crc32 == 0
    assert sharding.shard_table(empty).count() == 0


def test_written_shards_keep_null_and_repeated_ids(spark, edge, tmp_path):
    sharding.write_shards(edge, f"{tmp_path}/shards", 4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    key = lambda r: str(r)
    assert sorted(back.select(*edge.columns).collect(), key=key) == sorted(edge.collect(), key=key)
    place = ["doc_id", "shard", "slot", *[f"cell_{d}" for d in sharding.DIMENSIONS]]
    table = sharding.shard_table(edge, 4).select(*place)
    assert sorted(back.select(*place).collect(), key=key) == sorted(table.collect(), key=key)


def test_quality(edge, empty, labels):
    rows = quality.quality_table(edge, labels).collect()
    assert len(rows) == N and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert quality.quality_table(empty, labels).count() == 0
    assert quality.quality_table(edge, labels.limit(0)).count() == N


def test_pii(edge, empty):
    got = by_id(pii.span_table(edge).collect())
    assert got[8].n_email == 1 and got[8].spans == "email:38:45"
    assert got[4].spans == "" and pii.span_table(edge).count() == N
    assert pii.span_table(empty).count() == 0


def test_near_dedup(edge, empty):
    rows = near_dedup.class_table(edge).collect()
    assert len(rows) == N
    assert {r.class_id for r in rows if r.doc_id in (1, 2, 3, 9)} == {1}
    assert {r.class_size for r in rows if r.doc_id == 3} == {5}
    assert {r.doc_id: r.class_id for r in rows if r.doc_id in (4, 5, 7)} == {4: 4, 5: 5, 7: 7}
    kept = near_dedup.drop_near_duplicates(edge)
    assert kept.columns == edge.columns and kept.count() == N - 4
    assert near_dedup.class_table(empty).count() == 0
    assert near_dedup.drop_near_duplicates(empty).count() == 0


def test_stages_keep_columns_on_edges(spark, edge, empty, tmp_path):
    for name, df in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], df).write.parquet(f"{tmp_path}/{name}.parquet")
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            docs = out
        assert docs.count() == (6 if docs.count() else 0)
