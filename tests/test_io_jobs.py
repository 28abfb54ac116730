"""Readers/sinks round trips, end-to-end jobs, driver contract and oracle."""

import math
import os
import tempfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assayflow.plans import fixtures as fx
from assayflow.plans import jobs
from assayflow.sources import read_source, save_table, write_csv, write_dataset
from tests.conftest import SF001


def _scratch():
    return tempfile.mkdtemp(prefix="assayflow-test-")


def test_glob_directory_and_string_keys(spark):
    d = _scratch()
    for i in range(3):
        pd.DataFrame({"animal": [f"00{i}", f"01{i}"], "level": [1.0 * i, 2.0]}).to_csv(
            os.path.join(d, f"part{i}.csv"), index=False)
    g = read_source(spark, f"{d}/part*.csv", "csv", string_columns=["animal"])
    assert sorted(r.Source for r in g.select("Source").distinct().collect()) == [
        "part0.csv", "part1.csv", "part2.csv"]
    assert "000" in [r.animal for r in g.collect()]          # leading zeros kept
    whole = read_source(spark, d, "csv")
    assert whole.count() == 6 and "Source" not in whole.columns
    with pytest.raises(Exception):
        read_source(spark, f"{d}/missing.csv", "csv").collect()


def test_sinks_round_trip(spark):
    d = _scratch()
    df = spark.createDataFrame([("a", "x", 0.5), ("b", "y", 0.25)],
                               "metabolite string, time_point string, p_value double")
    write_csv(df, f"{d}/csv", partition_by=["time_point"], tidy_names=True)
    back = spark.read.option("header", "true").csv(f"{d}/csv")
    assert set(back.columns) == {"metabolite", "p.value", "time_point"} and back.count() == 2
    write_dataset(df, f"{d}/pq")
    assert spark.read.parquet(f"{d}/pq").count() == 2
    save_table(spark, df, "assayflow_test_db.res", f"{d}/tbl")
    assert spark.read.table("assayflow_test_db.res").count() == 2
    spark.sql("DROP TABLE assayflow_test_db.res")


def _write_csv_pd(df, path):
    df.toPandas().to_csv(path, index=False)
    return path


def test_metadata_cohort_and_grand_table_jobs(spark):
    d = _scratch()
    p = _write_csv_pd(fx.pheno(spark, SF001), f"{d}/pheno.csv")
    m = _write_csv_pd(fx.manifest(spark, SF001), f"{d}/manifest.csv")
    ids = fx.grand_wide(spark, SF001).select(
        F.replace(F.trim("sample_id"), F.lit(" "), F.lit("")).alias("sample_id"))
    s = _write_csv_pd(ids, f"{d}/samples.csv")
    meta = jobs.load_metadata(spark, p, m, s)
    assert dict(meta.pheno.dtypes)["animal"] == "string"
    eda = jobs.cohort_eda(meta, visits=("Day 0", "Day 10", "Day 20"))
    assert eda["visit_flags"].count() > 0 and eda["complete_cases"].count() == 1
    long = jobs.preprocessing_job(
        spark, fx.grand_wide(spark, SF001), meta, f"{d}/gt", id_vars=["sample_id", "animal_y"],
        steps=("replace_zero", "drop_na", "fill_na", "log", "scale"))
    assert long.count() > 0 and set(long.columns) == {"sample_id", "animal_y", "metabolite", "level"}
    cyt = jobs.cytokine_grand_table(fx.targets_wide(spark, SF001), meta)
    assert "metabolite" in cyt.columns


def test_ttest_volcano_regression_lod_jobs(spark):
    d = _scratch()
    v = fx.visits_long(spark, SF001)
    res = jobs.ttest_job(v, visits=("Day0", "Day10", "Day20"), out=f"{d}/tt")
    assert res.placebo.count() > 0
    back = spark.read.option("header", "true").csv(f"{d}/tt/treatment_paired_ttest")
    assert "p.value" in back.columns
    vol = jobs.volcano_job(res, v, visits=("Day0", "Day10", "Day20"))
    assert vol["paired_counts"].count() == 2
    a = fx.assay_long(spark, SF001).withColumnRenamed("metabolite", "feature_label")
    reg = jobs.regression_job(a, ["x_quantity", "x_acctbal"], covariate="site",
                              time_point="1996", out=f"{d}/reg")
    assert reg.select("independent_variable").distinct().count() == 2
    t = fx.targets_long(spark, SF001)
    out = jobs.lod_job(t.filter("is_blank").drop("is_blank"), t.filter("not is_blank").drop("is_blank"))
    assert out.filter(F.col("target") == "zero_target").count() == 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert {"metabolite", "Visit", "p_value", "statistic", "status"} <= set(df.columns)


def _norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


def test_every_query_matches_oracle_sf0001(spark):
    qs, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(qs) and len(qs) >= 45
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split():
        if os.path.exists(f"{SF001}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    bad = []
    for name, fn in qs.items():
        s = fn(spark, SF001).toPandas()
        if name not in oracle:
            continue
        o = con.sql(oracle[name]).df()
        cols = sorted(s.columns)
        if cols != sorted(o.columns):
            bad.append((name, "columns"))
            continue
        key = lambda t: tuple((x is None, str(x)) for x in t)
        rs = sorted((tuple(_norm(x) for x in r) for r in s[cols].itertuples(index=False)), key=key)
        ro = sorted((tuple(_norm(x) for x in r) for r in o[cols].itertuples(index=False)), key=key)
        if rs != ro:
            bad.append((name, "values"))
    assert not bad, bad


def test_table_read_and_republish(spark):
    from assayflow.sources import republish
    d = _scratch()
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "feature string, level double")
    write_csv(df, f"{d}/src_a")
    rep = republish(spark, {"feature_intensities": f"{d}/src_a"}, f"{d}/out", prefix="p1_serum_")
    r = rep.first()
    assert (r.name, r.n_rows, r.n_cols) == ("feature_intensities", 2, 2)
    assert r.path.endswith("p1_serum_feature_intensities")
    assert os.path.isdir(f"{d}/src_a")                       # sources are kept
    save_table(spark, df, "assayflow_test_db.t2", f"{d}/t2")
    assert read_source(spark, "assayflow_test_db.t2", "table").count() == 2
    spark.sql("DROP TABLE assayflow_test_db.t2")


def test_checkpoint_dir_is_read_from_session(spark):
    from assayflow.session import checkpoint_dir, cut_lineage
    path = checkpoint_dir(spark)
    assert path and checkpoint_dir(spark) == path             # stable once set
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10


def test_regression_job_from_catalog_table(spark):
    d = _scratch()
    a = fx.assay_long(spark, SF001)
    save_table(spark, a, "assayflow_test_db.mtb_pheno", f"{d}/mtb")
    res = jobs.regression_job_from_table(
        spark, "assayflow_test_db.mtb_pheno",
        ["time_point", "level", "metabolite", "site", "x_quantity", "x_acctbal"],
        covariate="site", independent_variables=["x_quantity", "x_acctbal"], time_point="1996",
        result_path=f"{d}/res")
    assert set(res.columns) >= {"feature_label", "independent_variable", "LR_P_Value",
                                "LR_Effect_Size", "LR_CI_Lower", "LR_CI_Upper"}
    back = spark.read.option("header", "true").csv(f"{d}/res")
    assert back.count() == res.count() and os.path.isdir(
        f"{d}/res/time_point=1996/independent_variable=x_acctbal")
    spark.sql("DROP TABLE assayflow_test_db.mtb_pheno")


def test_string_keys_on_typed_format(spark):
    d = _scratch()
    spark.createDataFrame([(7, 1.0), (8, 2.0)], "animal int, level double").write.parquet(f"{d}/p")
    df = read_source(spark, f"{d}/p", "parquet", string_columns=["animal"])
    assert dict(df.dtypes)["animal"] == "string" and sorted(r.animal for r in df.collect()) == ["7", "8"]


def test_study_config_runners(spark):
    from assayflow.plans.config import StudyConfig, run_preprocessing, run_regression
    d = _scratch()
    save_table(spark, fx.assay_long(spark, SF001), "assayflow_test_db.cfg_tbl", f"{d}/tbl")
    pheno = _write_csv_pd(fx.pheno(spark, SF001), f"{d}/pheno.csv")
    manifest = _write_csv_pd(fx.manifest(spark, SF001), f"{d}/manifest.csv")
    gw = fx.grand_wide(spark, SF001)
    samples = _write_csv_pd(gw.select(F.replace(F.trim("sample_id"), F.lit(" "), F.lit(""))
                                      .alias("sample_id")), f"{d}/samples.csv")
    assay = _write_csv_pd(gw, f"{d}/assay.csv")
    cfg = StudyConfig.from_nested({
        "data": {"table_name": "assayflow_test_db.cfg_tbl",
                 "selected_columns": ["time_point", "level", "metabolite", "site", "x_quantity"]},
        "analysis": {"covariate": "site", "independent_variable_list": ["x_quantity"],
                     "time_point": "1996", "result_path": f"{d}/res"},
        "files": {"pheno": pheno, "manifest": manifest, "sample_metadata": samples,
                  "metab": {"serum": assay}, "grand_table_path": f"{d}/gt"},
        "wide2long": {"id_vars_base": ["sample_id", "animal_y"]},
        "preprocessing": {"steps": ["replace_zero", "fill_na", "scale"],
                          "fill_na": {"impute_strategy": "min"}},
    })
    assert cfg.dropping_thres == 0.9 and cfg.steps == ("replace_zero", "fill_na", "scale")
    assert run_regression(spark, cfg).count() > 0
    assert run_preprocessing(spark, cfg).count() > 0
    spark.sql("DROP TABLE assayflow_test_db.cfg_tbl")


def test_time_points_are_written_side_by_side(spark, tmp_path):
    rows = [(f"m{i % 3}", str(1995 + i % 2), "a" if i % 5 else "b", float(i % 11 + 1), float(i * i % 17)) for i in range(120)]
    df = spark.createDataFrame(rows, "feature_label string, time_point string, site string, x double, level double")
    out = f"{tmp_path}/lr"
    read = lambda: spark.read.option("header", "true").csv(out)
    for year in ("1995", "1996"):
        jobs.regression_job(df, ["x"], covariate="site", time_point=year, out=out)
    both = sorted(map(tuple, read().collect()))
    assert {r.time_point for r in read().select("time_point").distinct().collect()} == {1995, 1996} or \
        {str(r.time_point) for r in read().select("time_point").distinct().collect()} == {"1995", "1996"}
    doubled = df.withColumn("level", F.col("level") * 2)
    jobs.regression_job(doubled, ["x"], covariate="site", time_point="1996", out=out)
    again = sorted(map(tuple, read().collect()))
    of = lambda rows, year: [r for r in rows if year in map(str, r)]
    assert of(again, "1995") == of(both, "1995") and of(again, "1996") != of(both, "1996") and len(again) == len(both)


def test_small_probabilities_are_reported(spark):
    from assayflow.operators.report import round_doubles, sql_reported
    row = round_doubles(spark.createDataFrame([(1.23456789e-9, 8.0891875, 0.0)], "p_value double, estimate double, p_bh double")).first()
    assert (row.p_value, row.estimate, row.p_bh) == (1.234568e-09, 8.089188, 0.0)
    import duckdb
    sql = sql_reported("SELECT round(1.23456789e-9, 6) AS p_value, round((8.0 + 0.0891875), 6) AS estimate, round(1, 2) AS x")
    assert duckdb.connect().execute(sql).fetchall() == [(1.234568e-09, 8.089188, 1)]
