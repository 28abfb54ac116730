"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Each query is executed in full through the ``noop``
sink (no driver collect). Also times the two comparisons named in
replaces, and the fused variable sweep vs one job per variable.
"""

from __future__ import annotations

import json
import os
import sys
import time

import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from assayflow.operators import multiple, ols  # noqa: E402
from assayflow.operators.quantile import group_median  # noqa: E402
from assayflow.plans import catalog  # noqa: E402
from assayflow.plans import fixtures as fx  # noqa: E402
from assayflow.plans.queries import SWEEP_VARIABLES, TIME_POINT  # noqa: E402
from assayflow.session import local_session  # noqa: E402

RUNS = 3
HEADLINE = [
    "welch_by_feature", "welch_all_arms", "paired_t", "unpaired_t", "ols_sweep",
    "ols_sweep_all_time_points", "volcano_all_contrasts",
    "ols_multi_covariate",
    "bh_adjust", "fdr_threshold", "fold_change_groups", "fold_change_visits", "volcano_dataset",
    "preprocess_steps", "impute_uniform", "melt_wide", "modified_z", "lod_correct_replace",
    "pheno_manifest_outer", "grand_table_inner", "visit_flags",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _no_frame(_) -> None:
    """The work is done already."""


def grouped_map_sweep(spark, d: str):
    """Reference-style baseline: one job per variable, each feature's rows
    shipped to a Python worker and fitted with a dummy-coded lstsq."""
    base = fx.assay_long(spark, d).withColumnRenamed("metabolite", "feature_label")
    out = []
    for iv in SWEEP_VARIABLES:
        sub = base.select("level", "feature_label", "site", "time_point", iv).filter(
            (F.col(iv) != 0) & F.col(iv).isNotNull() & (F.col("time_point") == TIME_POINT))

        def make_fit(iv: str):
            def fit(pdf: pd.DataFrame) -> pd.DataFrame:
                dummies = pd.get_dummies(pdf["site"], drop_first=True, dtype=float)
                X = np.column_stack([np.ones(len(pdf)), dummies.to_numpy(),
                                     pdf[iv].to_numpy(float)])
                y = pdf["level"].to_numpy(float)
                beta, *_ = np.linalg.lstsq(X, y, rcond=None)
                return pd.DataFrame({"feature_label": [pdf["feature_label"].iloc[0]],
                                     "independent_variable": [iv], "b": [float(beta[-1])]})
            return fit

        res = sub.groupBy("feature_label").applyInPandas(
            make_fit(iv), "feature_label string, independent_variable string, b double")
        out.append(res.toPandas())
    return pd.concat(out)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    qs = catalog.queries_map()
    _run(qs["clean_visit"](spark, sf_dir))  # warm up the JVM, not timed

    def median_of_runs(make) -> float:
        """Median of three runs, each planned anew."""
        seen = []
        for _ in range(RUNS):
            t0 = time.perf_counter()
            done = make()
            if done is not None:
                _run(done)
            seen.append(time.perf_counter() - t0)
        return round(sorted(seen)[len(seen) // 2], 3)

    timings = {name: median_of_runs(lambda q=name: qs[q](spark, sf_dir)) for name in (only or HEADLINE)}

    extra: dict[str, float] = {}
    if not only:
        long = fx.assay_long(spark, sf_dir).withColumnRenamed("metabolite", "feature_label")

        def native(variables):
            return ols.regress_features(long, list(variables), covariate="site", time_point=TIME_POINT)

        def per_variable() -> None:
            for iv in SWEEP_VARIABLES:
                _run(native([iv]))

        extra["ols_sweep_native_fused"] = median_of_runs(lambda: native(SWEEP_VARIABLES))
        # one job per variable on both sides
        extra["ols_sweep_native_per_variable"] = median_of_runs(per_variable)
        extra["ols_sweep_grouped_map_per_variable"] = median_of_runs(
            lambda: _no_frame(grouped_map_sweep(spark, sf_dir)))

        # What skew safety costs: exact median by distributed selection vs the
        # single-buffer percentile aggregate, over every (arm, visit, feature, group).
        v = fx.visits_long(spark, sf_dir)
        keys = ["Treatment", "Visit", "metabolite", "Progressive"]
        extra["median_selection"] = median_of_runs(lambda: group_median(v, keys, "level"))
        extra["median_percentile_aggregate"] = median_of_runs(
            lambda: v.groupBy(*keys).agg(F.median("level").alias("median")))

        res = ols.regress_features(long, list(SWEEP_VARIABLES), covariate="site", by=["time_point"])
        extra["bh_ranges"] = median_of_runs(lambda: multiple.bh_adjust(
            res, p="LR_P_Value", by=["time_point", "independent_variable"]))

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "comparisons": extra, "sf": sf,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
