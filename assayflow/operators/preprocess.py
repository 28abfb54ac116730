"""Per-feature preprocessing on the long model (Z1-Z9) and reshapes.

Every statistic is per feature over all samples: computed by one partial
aggregation and joined back as a written table (``joins.join_group_stats``),
so the rows are broadcast-joined and never shuffle while the per-feature table
is small. NaN is missing, like NULL, in every step.

Input shape: ``(id columns..., feature, level)`` with one row per
(sample, feature) cell - missing cells present with a NULL level, as
``melt`` produces them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.functions.scalar import hash_uniform, nan_to_null
from assayflow.operators.joins import join_group_stats

LOG_ZERO = 1e-200


def feature_columns(df: DataFrame, *, match: str | None = None, names: Sequence[str] | None = None,
                    mode: str = "substring") -> list[str]:
    """Feature columns by explicit list, by substring (the original
    behaviour, which also catches id columns containing the text) or by
    prefix. Reads column names only."""
    if names:
        return [c for c in names if c in df.columns]
    if match is None:
        raise ValueError("give names or match")
    if mode == "prefix":
        return [c for c in df.columns if c.startswith(match)]
    return [c for c in df.columns if match in c]


def melt(df: DataFrame, *, value_cols: Sequence[str], id_cols: Sequence[str] | None = None,
         var_name: str = "metabolite", value_name: str = "level") -> DataFrame:
    """Wide -> long, missing levels kept as NULL rows. Values are cast to
    double and NaN becomes NULL. Only ``id_cols`` are carried along, so
    project before melting wide tables."""
    value_cols = list(value_cols)
    if id_cols is None:
        id_cols = [c for c in df.columns if c not in value_cols]
    typed = df.select(*id_cols, *[nan_to_null(F.col(c)).alias(c) for c in value_cols])
    return typed.unpivot(list(id_cols), value_cols, var_name, value_name)


def transpose_assay(df: DataFrame, *, target_col: str = "targetName", prefix: str = "serum_",
                    sample_name: str = "sample_id", var_name: str = "metabolite",
                    value_name: str = "level") -> DataFrame:
    """R4 + P5: an assay file with targets in rows and one column per sample
    becomes the long model ``(sample_id, metabolite, level)``; the feature
    name is the target prefixed with the sample type. No matrix transpose:
    the sample columns are unpivoted."""
    samples = [c for c in df.columns if c != target_col]
    long = melt(df, value_cols=samples, id_cols=[target_col], var_name=sample_name,
                value_name=value_name)
    return long.select(sample_name, F.concat(F.lit(prefix), F.col(target_col)).alias(var_name),
                       value_name)


# --- steps -----------------------------------------------------------------

def replace_zero(df: DataFrame, *, value: str = "level", **_) -> DataFrame:
    """Zero (and NaN) -> missing."""
    v = nan_to_null(F.col(value))
    return df.withColumn(value, F.when(v != 0, v))


def missing_rates(df: DataFrame, *, feature: str = "metabolite", value: str = "level") -> DataFrame:
    """Fraction of missing cells per feature."""
    return df.groupBy(feature).agg(
        F.avg(nan_to_null(F.col(value)).isNull().cast("double")).alias("missing_rate"))


def drop_missing(df: DataFrame, *, feature: str = "metabolite", value: str = "level",
                 threshold: float = 0.9, **_) -> DataFrame:
    """Keep features whose missing rate is strictly below ``threshold``."""
    rates = missing_rates(df, feature=feature, value=value)
    return (join_group_stats(df, rates, [feature], "left")
            .filter(F.col("missing_rate") < threshold).drop("missing_rate"))


def drop_empty(df: DataFrame, *, feature: str = "metabolite", value: str = "level", **_) -> DataFrame:
    """Z6 (+G13): drop features with no present value."""
    present = df.groupBy(feature).agg(F.count(nan_to_null(F.col(value))).alias("_n"))
    return join_group_stats(df, present, [feature], "left").filter(F.col("_n") > 0).drop("_n")


def impute(df: DataFrame, *, strategy: str = "uniform", feature: str = "metabolite",
           value: str = "level", sample: str = "sample_id", seed: int = 10,
           drop_empty_features: bool = True, **_) -> DataFrame:
    """Fill missing levels per feature.

    ``min``: the feature minimum. ``zero``: 0. ``uniform``: a draw from
    [min/10, min) - the uniform comes from md5(feature|sample|seed), so it
    does not depend on row order or partitioning. Present values never change.
    Features that stay empty are dropped unless ``drop_empty_features`` is off.
    """
    if strategy not in ("zero", "min", "uniform"):
        raise ValueError(f"unknown imputation strategy {strategy!r}")
    if strategy == "zero":   # no feature stays empty
        return df.withColumn(value, F.coalesce(nan_to_null(F.col(value)), F.lit(0.0)))
    mins = df.groupBy(feature).agg(F.min(nan_to_null(F.col(value))).alias("_min"))
    return _filled(join_group_stats(df, mins, [feature], "left"), strategy, feature, value, sample, seed,
                   drop_empty_features).drop("_min")


def _filled(j: DataFrame, strategy: str, feature: str, value: str, sample: str, seed: int,
            drop_empty_features: bool = True) -> DataFrame:
    """Fill missing levels from the feature's ``_min`` (NULL: no value)."""
    if strategy == "min":
        fill = F.col("_min")
    else:
        u = hash_uniform(F.col(feature), F.col(sample), F.lit(str(seed)))
        lo = F.col("_min") / 10
        fill = lo + u * (F.col("_min") - lo)
    if drop_empty_features:
        j = j.filter(F.col("_min").isNotNull())
    return j.withColumn(value, F.coalesce(nan_to_null(F.col(value)), fill))


def log_transform(df: DataFrame, *, value: str = "level", **_) -> DataFrame:
    """Natural log with 0 -> 1e-200 first; negative levels become NULL."""
    v = nan_to_null(F.col(value))
    return df.withColumn(value, F.when(v == 0, F.lit(math.log(LOG_ZERO))).when(v > 0, F.ln(v)))


def standardize(df: DataFrame, *, feature: str = "metabolite", value: str = "level",
                **_) -> DataFrame:
    """Z8 (+G9, J6): z-score per feature with the population sd; missing
    values are ignored in the fit and stay missing; sd 0 divides by 1."""
    v = nan_to_null(F.col(value))
    st = df.groupBy(feature).agg(F.avg(v).alias("_mu"), F.stddev_pop(v).alias("_sd"))
    j = join_group_stats(df, st, [feature], "left")
    sd = F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd"))
    return j.withColumn(value, (v - F.col("_mu")) / sd).drop("_mu", "_sd")


# The step names of the study configuration.
STEP_NAMES = ("replace_zero", "drop_na", "fill_na", "log", "scale")


def run_steps(df: DataFrame, steps: Sequence[str] = ("scale",), *,
              impute_strategy: str = "uniform", dropping_thres: float = 0.9,
              feature: str = "metabolite", value: str = "level", sample: str = "sample_id",
              seed: int = 10) -> DataFrame:
    """Apply named steps in order (defaults as in the original:
    ``["scale"]``, uniform imputation, threshold 0.9). An unknown step name
    raises instead of being skipped.

    A step that needs statistics reads its input once and writes one row per
    feature; the rows themselves are never written. A missing-rate filter
    and the imputation right after it share one aggregation, so the usual run
    of steps makes two passes before the result is read."""
    unknown = [s for s in steps if s not in STEP_NAMES]
    if unknown:
        raise ValueError(f"unknown preprocessing steps {unknown}")
    kw = {"feature": feature, "value": value}
    todo = list(steps)
    while todo:
        step = todo.pop(0)
        if step == "drop_na" and todo[:1] == ["fill_na"] and impute_strategy in ("min", "uniform"):
            todo.pop(0)
            v = nan_to_null(F.col(value))
            stats = df.groupBy(feature).agg(F.avg(v.isNull().cast("double")).alias("missing_rate"),
                                            F.min(v).alias("_min"))
            kept = join_group_stats(df, stats, [feature], "left").filter(F.col("missing_rate") < dropping_thres)
            df = _filled(kept, impute_strategy, feature, value, sample, seed).drop("missing_rate", "_min")
        elif step == "drop_na":
            df = drop_missing(df, threshold=dropping_thres, **kw)
        elif step == "fill_na":
            df = impute(df, strategy=impute_strategy, sample=sample, seed=seed, **kw)
        else:
            df = {"replace_zero": replace_zero, "log": log_transform, "scale": standardize}[step](df, **kw)
    return df


def missing_report(df: DataFrame, *, feature: str = "metabolite", value: str = "level",
                   threshold: float = 0.9) -> DataFrame:
    """How many features the missing-rate filter drops, as one row."""
    rates = missing_rates(df, feature=feature, value=value)
    return rates.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count(F.when(F.col("missing_rate") >= threshold, 1)).alias("n_dropped"),
        F.count(F.when(F.col("missing_rate") == 1.0, 1)).alias("n_empty"),
    ).withColumn("pct_dropped", F.round(100 * F.col("n_dropped") / F.col("n_features"), 1)) \
     .withColumn("threshold", F.lit(float(threshold)))
