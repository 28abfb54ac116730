"""BH, medians, preprocessing, LOD, fold change, cohort: edge fixtures and properties."""

import math

import numpy as np
import pytest

from assayflow.operators import cohort, foldchange, lod, multiple, preprocess, volcano
from assayflow.operators.quantile import group_median


def _bh_np(p):
    p = np.asarray(p, float)
    m = len(p)
    order = np.argsort(p)
    q = p[order] * m / np.arange(1, m + 1)
    adj = np.minimum.accumulate(q[::-1])[::-1]
    out = np.empty(m)
    out[order] = np.minimum(adj, 1)
    return out


def test_bh_vectors(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([.01, .02, .03, .5, None])],
                               "f int, p_value double")
    got = {r.f: r.p_bh for r in multiple.bh_adjust(df).collect()}
    assert [round(got[i], 10) for i in range(4)] == [.04, .04, .04, .5] and got[4] is None
    single = spark.createDataFrame([(0, 0.3)], "f int, p_value double")
    assert multiple.bh_adjust(single).first().p_bh == pytest.approx(0.3)


def test_bh_matches_numpy_with_ties_and_contrasts(spark):
    rng = np.random.default_rng(7)
    rows = []
    for c in ("a", "b"):
        p = np.concatenate([rng.uniform(size=300), rng.uniform(0, 1e-3, 50), np.full(40, 1.0),
                            np.full(30, 0.2)])
        rows += [(c, i, float(v)) for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "c string, f int, p_value double").repartition(5)
    got = multiple.bh_adjust(df, by=["c"]).toPandas()
    for c in ("a", "b"):
        sub = got[got.c == c].sort_values("f")
        np.testing.assert_allclose(sub.p_bh.to_numpy(), _bh_np(sub.p_value.to_numpy()), rtol=1e-12)
        # monotone in p and at most 1
        s = sub.sort_values("p_value")
        assert (np.diff(s.p_bh.to_numpy()) >= -1e-15).all() and (s.p_bh <= 1).all()


def test_fdr_threshold_and_compat(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([.001, .002, .2, .6])],
                               "f int, p_value double")
    adj = multiple.bh_adjust(df)
    r = multiple.fdr_threshold(adj, fdr=0.1, feature="f").first()
    assert r.p_threshold == pytest.approx(0.2) and r.n_significant == 2
    tiny = spark.createDataFrame([(0, 1e-9), (1, 2e-9)], "f int, p_value double")
    a2 = multiple.bh_adjust(tiny)
    assert math.isinf(multiple.fdr_threshold(a2).first().p_threshold)
    assert multiple.fdr_threshold(a2, compat=True).first().p_threshold == pytest.approx(1e-9)


def test_group_median_matches_numpy_with_hot_group(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 50, 20001)]      # many ties
    rows += [("odd", float(v)) for v in rng.normal(size=7)]
    rows += [("even", float(v)) for v in rng.normal(size=8)]
    rows += [("nulls", None), ("nulls", 1.0), ("nulls", 3.0), ("allnull", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r.median for r in group_median(df, ["g"], "v").collect()}
    for g in ("hot", "odd", "even"):
        assert got[g] == pytest.approx(np.median([v for k, v in rows if k == g]))
    assert got["nulls"] == 2.0 and "allnull" not in got


def _long(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, metabolite string, level double")


def test_impute_never_alters_present_values_and_uniform_range(spark):
    rows = [(f"s{i}", "a", float(i) if i % 3 else None) for i in range(1, 30)]
    rows += [(f"s{i}", "empty", None) for i in range(1, 5)]
    df = _long(spark, rows)
    for strategy in ("min", "zero", "uniform"):
        out = {(r.sample_id, r.metabolite): r.level
               for r in preprocess.impute(df, strategy=strategy).collect()}
        assert ("s1", "empty") not in out or strategy == "zero"
        for s, f, v in rows:
            if v is not None:
                assert out[(s, f)] == v
        if strategy == "uniform":
            filled = [out[(s, f)] for s, f, v in rows if v is None and f == "a"]
            assert all(0.1 <= x < 1.0 for x in filled)
    again = preprocess.impute(df.repartition(3), strategy="uniform").orderBy("sample_id").collect()
    first = preprocess.impute(df, strategy="uniform").orderBy("sample_id").collect()
    assert again == first  # order / partitioning independent


def test_log_edge_and_standardize(spark):
    df = _long(spark, [("s1", "a", 0.0), ("s2", "a", -1.0), ("s3", "a", None), ("s4", "a", math.e)])
    got = {r.sample_id: r.level for r in preprocess.log_transform(df).collect()}
    assert got["s1"] == pytest.approx(math.log(1e-200)) and got["s2"] is None
    assert got["s3"] is None and got["s4"] == pytest.approx(1.0)
    z = _long(spark, [(f"s{i}", "a", float(i)) for i in range(10)] +
              [(f"s{i}", "c", 5.0) for i in range(3)])
    out = preprocess.standardize(z).toPandas()
    a = out[out.metabolite == "a"].level
    assert a.mean() == pytest.approx(0, abs=1e-12) and a.std(ddof=0) == pytest.approx(1)
    assert (out[out.metabolite == "c"].level == 0).all()
    with pytest.raises(ValueError):
        preprocess.run_steps(z, ["scale", "nope"])


def test_drop_missing_threshold_is_strict(spark):
    rows = [(f"s{i}", "half", 1.0 if i < 5 else None) for i in range(10)]
    rows += [(f"s{i}", "full", 1.0) for i in range(10)]
    df = _long(spark, rows)
    kept = {r.metabolite for r in preprocess.drop_missing(df, threshold=0.5).collect()}
    assert kept == {"full"}
    rep = preprocess.missing_report(df, threshold=0.5).first()
    assert (rep.n_features, rep.n_dropped, rep.pct_dropped) == (2, 1, 50.0)


def _targets(spark, rows):
    return spark.createDataFrame(rows, "target string, sample_pos long, sample string, level double")


def test_mad_edge_and_outlier_masking(spark):
    rows = [("t", i, f"s{i}", v) for i, v in enumerate([1.0, 1.0, 1.0, 1.0, 9.0, 9.0])]
    rows += [("p", i, f"s{i}", v) for i, v in enumerate([1.0, 2.0, None, 100.0])]   # poisoned
    rows += [("c", i, f"s{i}", 2.0) for i in range(4)]                               # MAD = 0
    df = _targets(spark, rows)
    z = {(r.target, r.sample_pos): r.score for r in lod.modified_z(df).collect()}
    assert z[("t", 4)] > 2 and z[("p", 0)] is None and z[("c", 0)] == 0.0
    masked = {(r.target, r.sample_pos): r.level for r in lod.mask_outliers(df).collect()}
    assert masked[("t", 4)] is None and masked[("t", 5)] == 9.0   # tie: first position only
    assert masked[("p", 3)] == 100.0                                # poisoned: nothing masked


def test_lod_edge(spark):
    samples = _targets(spark, [
        ("CRP", 0, "s0", 1.0), ("CRP", 1, "s1", 10.0),       # exempt, partly below
        ("KNG1", 0, "s0", 1.0), ("KNG1", 1, "s1", 2.0),      # exempt, all below -> dropped
        ("a", 0, "s0", 1.0), ("a", 1, "s1", 10.0),
        ("nolod", 0, "s0", 1.0),                              # no LOD -> never below
        ("z", 0, "s0", 0.0), ("z", 1, "s1", 0.0)])            # all zero -> dropped
    lods = samples.sparkSession.createDataFrame(
        [("CRP", 5.0), ("KNG1", 5.0), ("a", 5.0), ("z", -1.0)], "target string, LOD double")
    rep = {(r.target, r.sample): r.level for r in lod.lod_correct(samples, lods).collect()}
    assert rep[("CRP", "s0")] == 1.0 and ("KNG1", "s0") not in rep
    assert rep[("a", "s0")] == 5.0 and rep[("nolod", "s0")] == 1.0 and ("z", "s0") not in rep
    miss = {(r.target, r.sample): r.level
            for r in lod.lod_correct(samples, lods, strategy="missing").collect()}
    assert miss[("a", "s0")] is None and miss[("a", "s1")] == 10.0


def test_fold_change_edges_and_volcano(spark):
    df = spark.createDataFrame(
        [("m1", 0, 0.0), ("m1", 1, 2.0), ("m2", 0, 2.0), ("m2", 1, 4.0), ("m3", 1, 1.0)],
        "metabolite string, Progressive int, level double")
    fc = {r.metabolite: r for r in foldchange.fold_change_groups(df).collect()}
    assert fc["m1"].fold_change is None and fc["m2"].log2_fold_change == pytest.approx(1.0)
    assert fc["m3"].non_progressive is None
    stats = spark.createDataFrame([("m2", 0.0), ("m9", 0.5)], "metabolite string, p_value double")
    vol = {r.metabolite: r for r in volcano.volcano_table(stats, foldchange.fold_change_groups(df))
           .collect()}
    assert set(vol) == {"m1", "m2", "m3", "m9"}
    assert math.isinf(vol["m2"].log_p) and vol["m2"].is_sig and not vol["m2"].has_id
    assert vol["m1"].is_sig is False and vol["m9"].log2_fold_change is None


def test_null_safe_outer_join_and_flags(spark):
    pheno = spark.createDataFrame([(None, "Day 0", "T01", 1), (None, "Day 0", "T01", 1),
                                   ("2", "Day 0", "T03", 0)],
                                  "animal string, visit_dcf string, Treatment string, Progressive int")
    man = spark.createDataFrame([(None, "Day 0", "T01", "x-1"), ("3", "Day 0", "T01", "3-1")],
                                "case_id string, Visit string, treatment_id string, custom_id string")
    pc = cohort.combine_pheno_manifest(pheno, man).collect()
    assert len(pc) == 3  # null keys matched, duplicate pheno row removed
    assert any(r.animal is None and r.custom_id == "x-1" for r in pc)
    cnt = cohort.distinct_counts(man, ["case_id"]).first()
    assert cnt.n_case_id == 2
    fl = cohort.visit_flags(spark.createDataFrame(
        [("a", "Day 0"), ("a", "Day 0"), ("a", "Day 10"), (None, "Day 0")],
        "case_id string, Visit string"), visits=("Day 0", "Day 10", "Day 20")).collect()
    assert len(fl) == 1 and fl[0]["count"] == 2 and fl[0].has_day0 and not fl[0].has_day20
