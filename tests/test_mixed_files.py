"""Files with malformed rows and mixed headers; outer joins with hot keys; the
cytokine path."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from assayflow.functions.scalar import clean_id
from assayflow.operators import cohort, preprocess
from assayflow.plans import fixtures as fx
from assayflow.plans import jobs
from assayflow.sources import bad_rows, good_rows, read_delimited, rows_per_file
from tests.conftest import SF001

TYPES = StructType([StructField("animal", StringType()), StructField("level", DoubleType())])


def _files(folder: Path, **texts: str) -> str:
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_exchanged_and_missing_columns_are_united_by_name(spark, tmp_path):
    d = _files(tmp_path, a="animal,level\n001,1.5\n002,2\n", b="level,animal,arm\n3.5,003,T01\n", c="animal,level\n004,4\n")
    rows = good_rows(read_delimited(spark, d, types=TYPES))
    got = {tuple(r[c] for c in ("animal", "level", "arm", "Source")) for r in rows.collect()}
    assert got == {("001", 1.5, None, "a.csv"), ("002", 2.0, None, "a.csv"),
                   ("003", 3.5, "T01", "b.csv"), ("004", 4.0, None, "c.csv")}


def test_malformed_rows_are_reported_with_their_file(spark, tmp_path):
    d = _files(tmp_path, a="animal,level\n001,1.5\n002\n003,3,4\n", b="level,animal\nmuch,004\n5,\"0,5\"\n", c="", d="animal,level\n")
    rows = read_delimited(spark, d, types=TYPES)
    assert {(r.animal, r.level) for r in good_rows(rows).collect()} == {("001", 1.5), ("0,5", 5.0)}
    assert {(r.Source, r.bad_record) for r in bad_rows(rows).collect()} == {
        ("a.csv", "002"), ("a.csv", "003,3,4"), ("b.csv", "much,004")}
    assert {tuple(r) for r in rows_per_file(rows).collect()} == {("a.csv", 3, 2), ("b.csv", 2, 1)}
    assert rows.select("bad_record").count() == 5       # the records alone can be read too


def test_absent_and_repeated_columns_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="level"):
        read_delimited(spark, _files(tmp_path, a="animal,size\n1,2\n"), types=TYPES)
    with pytest.raises(ValueError, match="twice"):
        read_delimited(spark, _files(tmp_path, a="animal,animal,level\n1,2,3\n"), types=TYPES)


def test_outer_join_of_hot_keys_keeps_every_row(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (3, "e")], "k int, x string")
    right = spark.createDataFrame([(1, "p"), (None, "q"), (None, "r"), (4, "s"), (4, "s")], "m int, y string")
    for a, b in ((left, right), (left.limit(0), right), (left, right.limit(0)), (left, right.filter("m = 4"))):
        want = cohort.outer_join_keys(a, b, ["k"], ["m"])
        got = cohort.outer_join_hot_keys(a, b, ["k"], ["m"])
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_hot_key_is_split(spark):
    """The inner join, which holds the hot key's rows, is planned as skewed."""
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = spark.range(0, 30_000, 1, 8).selectExpr("if(id % 3 = 0, null, id) AS k", "md5(cast(id AS string)) AS x")
        right = spark.range(0, 300).selectExpr("if(id = 0, null, id) AS m", "id AS y")
        joined = cohort.outer_join_hot_keys(left, right, ["k"], ["m"])
        rows = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 30_000 + sum(1 for i in range(1, 300) if i % 3 == 0)
    assert "skew=true" in plan


def test_cytokines_are_scaled_and_their_raw_table_is_written(spark, tmp_path):
    assay = fx.targets_wide(spark, SF001)
    samples = preprocess.transpose_assay(assay).select(clean_id(F.col("sample_id")).alias("custom_id")).distinct()
    meta = jobs.Metadata(samples, samples, samples, samples)
    out = jobs.cytokine_preprocessing_job(spark, assay, meta, str(tmp_path))
    raw = spark.read.parquet(f"{tmp_path}/grand_cytokine_raw")
    assert raw.count() == out.count() > 0
    stats = out.filter("level IS NOT NULL").groupBy("metabolite").agg({"level": "avg"}).collect()
    assert stats and all(abs(r[1]) < 1e-6 for r in stats)
