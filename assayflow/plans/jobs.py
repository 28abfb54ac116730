"""End-to-end jobs (D1-D11): the original notebooks' flows as Spark jobs.

Each job is a function over DataFrames (or paths) returning DataFrames and
optionally writing them with the sinks; loops over time points, variables
and contrasts of the original become grouping columns, and result sets are
written partitioned instead of one file per loop value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.functions.scalar import clean_id, clean_visit
from assayflow.operators import cohort, foldchange, lod, ols, preprocess, ttest, volcano
from assayflow.session import written
from assayflow.sources.readers import read_source, read_stage
from assayflow.sources.sinks import write_csv, write_dataset


@dataclass(frozen=True)
class Metadata:
    """D1 output: the four metadata tables."""
    pheno: DataFrame
    manifest: DataFrame
    combined: DataFrame
    sample_metadata: DataFrame


def load_metadata(spark: SparkSession, pheno_path: str, manifest_path: str,
                  sample_metadata_path: str, *, fmt: str = "csv",
                  pheno_keys: Sequence[str] = ("animal", "visit_dcf", "Treatment"),
                  manifest_keys: Sequence[str] = ("case_id", "Visit", "treatment_id")) -> Metadata:
    """D1 (A1, A7, F4, J1): key columns are read as strings from the start."""
    pheno = read_source(spark, pheno_path, fmt, string_columns=[pheno_keys[0]])
    manifest = read_source(spark, manifest_path, fmt, string_columns=[manifest_keys[0]])
    samples = read_source(spark, sample_metadata_path, fmt, string_columns=["sample_id"])
    combined = cohort.combine_pheno_manifest(pheno, manifest, pheno_keys=pheno_keys,
                                             manifest_keys=manifest_keys)
    return Metadata(cohort.dedup_rows(pheno), manifest, combined, samples)


def metabolomics_grand_table(assay: DataFrame, meta: Metadata, *, out: str | None = None,
                             fmt: str = "parquet") -> DataFrame:
    """D2 (X1, J2, S2): wide assay rows joined to the cohort by cleaned id."""
    gt = cohort.grand_table(assay, meta.combined)
    if out:
        write_dataset(gt, out, fmt=fmt)
    return gt


def cytokine_grand_table(assay_targets_in_rows: DataFrame, meta: Metadata, *,
                         target_col: str = "targetName", prefix: str = "serum_",
                         out: str | None = None) -> DataFrame:
    """D3 (R4, P5, X1, J2, S2): targets-in-rows assay -> long -> joined to the
    cohort, written to ``out`` if given. Stays long; no wide pivot over an
    unknown number of targets."""
    long = preprocess.transpose_assay(assay_targets_in_rows, target_col=target_col, prefix=prefix)
    long = long.withColumn("sample_id", clean_id(F.col("sample_id")))
    grand = long.join(meta.combined, long["sample_id"] == meta.combined["custom_id"], "inner")
    if out:
        write_dataset(grand, out)
    return grand


def cytokine_preprocessing_job(spark: SparkSession, assay_targets_in_rows: DataFrame, meta: Metadata,
                               base: str, *, steps: Sequence[str] = ("scale",),
                               target_col: str = "targetName", prefix: str = "serum_",
                               raw_data: bool = False, name: str = "grand_cytokine") -> DataFrame:
    """D4 for cytokines (D3 -> A8 -> Z9): the raw grand table is written,
    read again by stage, preprocessed per target - by scaling alone unless
    other steps are named - and written; with ``raw_data`` it is written as
    it is."""
    cytokine_grand_table(assay_targets_in_rows, meta, target_col=target_col, prefix=prefix,
                         out=f"{base.rstrip('/')}/{name}_raw")
    long = read_stage(spark, base, name, "raw")
    if not raw_data:
        long = preprocess.run_steps(long, steps)
    stage = "raw_long" if raw_data else "preprocessed_long"
    write_dataset(long, f"{base.rstrip('/')}/{name}_{stage}")
    return read_stage(spark, base, name, stage)


def long_format(grand: DataFrame, *, id_vars: Sequence[str], match: str = "serum",
                var_name: str = "metabolite") -> DataFrame:
    """D5 (R1, P3): melt the feature columns, carrying the configured ids."""
    cols = [c for c in preprocess.feature_columns(grand, match=match) if c not in id_vars]
    return preprocess.melt(grand, value_cols=cols, id_cols=list(id_vars), var_name=var_name)


def preprocessing_job(spark: SparkSession, assay: DataFrame, meta: Metadata, base: str, *,
                      id_vars: Sequence[str], steps: Sequence[str] = ("scale",),
                      impute_strategy: str = "uniform", dropping_thres: float = 0.9,
                      raw_data: bool = False, sample: str = "sample_id",
                      name: str = "grand_serum") -> DataFrame:
    """D6 (D2 -> A8 -> D4 -> D5): raw grand table written, re-read by stage,
    preprocessed per feature on the long model and written long. With
    ``raw_data`` the long export is the raw table (the flag is honoured)."""
    metabolomics_grand_table(assay, meta, out=f"{base.rstrip('/')}/{name}_raw")
    grand = read_stage(spark, base, name, "raw")
    long = long_format(grand, id_vars=id_vars)
    if not raw_data:
        long = preprocess.run_steps(long, steps, impute_strategy=impute_strategy,
                                    dropping_thres=dropping_thres, sample=sample)
    stage = "raw_long" if raw_data else "preprocessed_long"
    write_dataset(long, f"{base.rstrip('/')}/{name}_{stage}")
    return read_stage(spark, base, name, stage)


def regression_job(df: DataFrame, independent_variables: Sequence[str], *, covariate: str,
                   time_point: str, out: str | None = None,
                   numeric_covariates: Sequence[str] = ()) -> DataFrame:
    """D7 (P1, F1, M1, M2, S4): all variables in one job; results written
    partitioned by time point and variable (one folder where the original
    wrote one CSV); a later time point is written beside earlier ones, the
    same one again replaces itself."""
    res = ols.regress_features(df, independent_variables, covariate=covariate,
                               numeric_covariates=numeric_covariates, time_point=time_point)
    res = res.withColumn("time_point", F.lit(time_point))
    if out:
        write_csv(res, out, partition_by=["time_point", "independent_variable"])
    return res


def regression_job_from_table(spark: SparkSession, table_name: str, selected_columns: Sequence[str],
                              *, covariate: str, independent_variables: Sequence[str],
                              time_point: str, result_path: str | None = None,
                              feature: str = "metabolite") -> DataFrame:
    """D7 as configured in the original notebooks: read the catalog table
    (A5), keep the selected columns and rename the feature column to
    ``feature_label`` (P1), fit every independent variable in one job (M2)
    and write the results partitioned by time point and variable (S4)."""
    data = (read_source(spark, table_name, "table").select(*selected_columns)
            .withColumnRenamed(feature, "feature_label"))
    return regression_job(data, independent_variables, covariate=covariate,
                          time_point=time_point, out=result_path)


@dataclass(frozen=True)
class TTestResults:
    placebo: DataFrame
    paired: DataFrame
    unpaired: DataFrame


def ttest_job(long: DataFrame, *, placebo: str = "T01", treated: str = "T03",
              visits: Sequence[str] = ("Day0", "Day168", "Day336"),
              out: str | None = None, on_duplicate: str = "error") -> TTestResults:
    """D8 (X2, F2, M3, R3, M4, M5, S4): Welch per visit in the placebo arm,
    paired and unpaired baseline-vs-visit tests in the treated arm, from one
    written visit pivot; the result tables (one row per feature) are written
    too, so each is computed once however often it is used."""
    v = long.withColumn("Visit", clean_visit("Visit"))
    pl = written(ttest.welch_by_group(v.filter(F.col("Treatment") == placebo), by=["Visit"]), "welch")
    wide = written(ttest.pivot_visits(v.filter(F.col("Treatment") == treated), values=visits,
                                      on_duplicate=on_duplicate), "visits")
    pa = written(ttest.paired_t(wide, baseline=visits[0], timepoints=visits[1:]), "paired")
    un = written(ttest.unpaired_t(wide, baseline=visits[0], timepoints=visits[1:]), "unpaired")
    if out:
        write_csv(pl, f"{out}/placebo_ttest", partition_by=["Visit"], tidy_names=True)
        write_csv(pa, f"{out}/treatment_paired_ttest", partition_by=["time_point"], tidy_names=True)
        write_csv(un, f"{out}/treatment_independent_ttest", partition_by=["time_point"],
                  tidy_names=True)
    return TTestResults(pl, pa, un)


def volcano_job(tests: TTestResults, raw_long: DataFrame, *, placebo: str = "T01",
                treated: str = "T03", visits: Sequence[str] = ("Day0", "Day168", "Day336"),
                p_threshold: float = 1e-4) -> dict[str, DataFrame]:
    """D9 (M16, M8, M9, J3, M14, F7): volcano tables of every contrast and
    their significance counts. The tests come from the preprocessed table,
    the medians from ``raw_long``: a ratio of z-score medians means nothing."""
    v = raw_long.withColumn("Visit", clean_visit("Visit"))
    fc_g = foldchange.fold_change_groups(v.filter(F.col("Treatment") == placebo), by=["Visit"])
    fc_v = foldchange.fold_change_visits(v.filter(F.col("Treatment") == treated),
                                         baseline=visits[0], timepoints=visits[1:])
    out = {
        "placebo": volcano.volcano_table(tests.placebo, fc_g, by=["Visit"], threshold=p_threshold),
        "paired": volcano.volcano_table(tests.paired, fc_v, by=["time_point"],
                                        threshold=p_threshold),
        "unpaired": volcano.volcano_table(tests.unpaired, fc_v, by=["time_point"],
                                          threshold=p_threshold),
    }
    out["placebo_counts"] = volcano.significance_counts(out["placebo"], by=["Visit"])
    out["paired_counts"] = volcano.significance_counts(out["paired"], by=["time_point"])
    out["unpaired_counts"] = volcano.significance_counts(out["unpaired"], by=["time_point"])
    return out


def cohort_eda(meta: Metadata, *, visits: Sequence[str] = ("Day 0", "Day 168", "Day 336"),
               case_col: str = "case_id") -> dict[str, DataFrame]:
    """D10 (J4, G1-G5, F8): cohort description tables."""
    swm = cohort.with_assay_data(meta.combined, meta.sample_metadata)
    flags = cohort.visit_flags(swm, case_col=case_col, visits=visits)
    return {
        "samples_with_assay": swm,
        "visit_flags": flags,
        "complete_cases": cohort.complete_cases(flags, n_visits=len(visits)),
        "n_cases": cohort.distinct_counts(swm, [case_col]),
        "breakdown": cohort.breakdown(swm),
        "duplicates": cohort.duplicated_samples(meta.combined, keys=(case_col, "Visit")),
    }


def lod_job(blanks: DataFrame, samples: DataFrame, *, strategy: str = "replace_with_LOD",
            singleplex: bool = False, exempt: Sequence[str] = lod.EXEMPT_TARGETS) -> DataFrame:
    """D11 (M10-M13): LOD from the masked blanks, applied to the samples."""
    lods = lod.lod(blanks, singleplex=singleplex)
    return lod.lod_correct(samples, lods, strategy=strategy, exempt=exempt)
