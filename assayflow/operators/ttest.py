"""Per-feature t-tests (M3-M5) as declarative aggregates.

Every test is one ``groupBy(by + feature).agg(count, avg, var_samp)`` - a
partial (map-side) aggregation, so the shuffle carries one row per
(map partition, feature) whatever the group sizes - followed by a projection
that turns the moments into statistic, df, p-value and confidence interval
(``functions.tdist``).

Failures that make R's ``t.test`` stop (too few observations, constant data,
not exactly two groups) give NULL test fields and a ``status`` other than
``'ok'`` for that feature instead of aborting the whole run.

Output columns use underscores (``p_value``, ``conf_low``); ``to_tidy_names``
renames them to the dotted names of the original result files at the sink.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayflow.functions.scalar import nan_to_null
from assayflow.functions.tdist import t_critical, t_two_sided_p

# Fixed values that must match the original result files.
WELCH_METHOD = "Welch Two Sample t-test"
PAIRED_METHOD = "Paired t-test"
TWO_SIDED = "two.sided"
DOUBLE_EPS = 2.220446049250313e-16  # R's .Machine$double.eps

TIDY_NAMES = {"p_value": "p.value", "conf_low": "conf.low", "conf_high": "conf.high"}


def to_tidy_names(df: DataFrame) -> DataFrame:
    for k, v in TIDY_NAMES.items():
        if k in df.columns:
            df = df.withColumnRenamed(k, v)
    return df


def _finish(df: DataFrame, keys: list[str], *, estimate: Column, stderr: Column,
            dof: Column, status: Column, method: str, alpha: float,
            extra: list[Column] = ()) -> DataFrame:
    """Shared projection: statistic, p, CI from estimate / stderr / df.

    Runs over one row per feature, so the per-row ``reflect`` calls of the
    t distribution are cheap."""
    staged = df.select(*keys, estimate.alias("estimate"), *extra, stderr.alias("_se"),
                       dof.alias("_df"), status.alias("status"))
    extra_names = [c for c in staged.columns
                   if c not in {*keys, "estimate", "_se", "_df", "status"}]
    is_ok = F.col("status") == "ok"
    staged = staged.withColumn("statistic", F.when(is_ok, F.col("estimate") / F.col("_se")))
    # the critical value is its own column, so each row runs the bisection once
    staged = staged.withColumn("_crit", F.when(is_ok, t_critical("_df", alpha)))
    crit = F.col("_crit")
    out = staged.select(
        *keys, "estimate", *extra_names,
        "statistic",
        F.when(is_ok, t_two_sided_p("statistic", "_df")).alias("p_value"),
        F.when(is_ok, F.col("_df")).alias("parameter"),
        F.when(is_ok, F.col("estimate") - crit * F.col("_se")).alias("conf_low"),
        F.when(is_ok, F.col("estimate") + crit * F.col("_se")).alias("conf_high"),
        F.lit(method).alias("method"),
        F.lit(TWO_SIDED).alias("alternative"),
        "status",
    )
    return out


def _welch_from_moments(n0, m0, v0, n1, m1, v1, extra_bad: Column | None = None):
    """Welch estimate, stderr, df and status from group moments."""
    s0 = v0 / n0
    s1 = v1 / n1
    se = F.sqrt(s0 + s1)
    dof = F.try_divide((s0 + s1) * (s0 + s1),
                       s0 * s0 / (n0 - 1) + s1 * s1 / (n1 - 1))
    status = (
        F.when((n0 == 0) | (n1 == 0), F.lit("need_two_groups"))
        .when(n0 < 2, F.lit("not_enough_x"))
        .when(n1 < 2, F.lit("not_enough_y"))
        .when((se <= 0) | (se < 10 * DOUBLE_EPS * F.greatest(F.abs(m0), F.abs(m1))),
              F.lit("constant"))
        .otherwise(F.lit("ok"))
    )
    if extra_bad is not None:
        status = F.when(extra_bad, F.lit("need_two_groups")).otherwise(status)
    return m0 - m1, se, dof, status


def welch_by_group(df: DataFrame, *, feature: str = "metabolite", group: str = "Progressive",
                   value: str = "level", by: Sequence[str] = (), groups=(0, 1),
                   alpha: float = 0.05) -> DataFrame:
    """M3: Welch two-sample t-test of ``value ~ group`` per feature (and ``by``).

    ``groups`` are the two labels in sorted order; estimate = mean(groups[0])
    - mean(groups[1]) as R reports it. Rows with a missing (NULL or NaN) value
    or a NULL group are dropped first, like a model frame.
    """
    g0, g1 = groups
    keys = [*by, feature]
    val, grp = nan_to_null(F.col(value)), F.col(group)
    x = F.when(grp == F.lit(g0), val)
    y = F.when(grp == F.lit(g1), val)
    other = F.when(val.isNotNull() & grp.isNotNull() & ~grp.isin(g0, g1), 1)
    mom = (
        df.filter(val.isNotNull() & grp.isNotNull())
        .groupBy(*keys)
        .agg(F.count(x).alias("_n0"), F.avg(x).alias("_m0"), F.var_samp(x).alias("_v0"),
             F.count(y).alias("_n1"), F.avg(y).alias("_m1"), F.var_samp(y).alias("_v1"),
             F.count(other).alias("_nother"))
    )
    n0, m0, v0 = F.col("_n0"), F.col("_m0"), F.col("_v0")
    n1, m1, v1 = F.col("_n1"), F.col("_m1"), F.col("_v1")
    est, se, dof, status = _welch_from_moments(n0, m0, v0, n1, m1, v1,
                                               extra_bad=F.col("_nother") > 0)
    return _finish(mom, keys, estimate=est, stderr=se, dof=dof, status=status,
                   method=WELCH_METHOD, alpha=alpha,
                   extra=[m0.alias("estimate1"), m1.alias("estimate2")])


def pivot_visits(df: DataFrame, *, id_cols: Sequence[str] = ("metabolite", "animal"),
                 names_from: str = "Visit", values_from: str = "level",
                 values: Sequence[str] = ("Day0", "Day10", "Day20"),
                 fill: float | None = 0.0, on_duplicate: str = "error") -> DataFrame:
    """Long -> wide by visit with ``fill`` for *absent* cells.

    A cell whose row exists but whose level is missing (NULL or NaN) is NULL;
    only cells with no row at all get ``fill``. Duplicate rows in a cell fail
    the job, or are averaged with ``on_duplicate="avg"``. ``id_cols`` is explicit
    (never "all other columns"). The pivot values are always given, so no
    extra job collects them.
    """
    if on_duplicate not in ("avg", "error"):
        raise ValueError(f"on_duplicate must be 'avg' or 'error', not {on_duplicate!r}")
    name = F.col(names_from)
    aggs = []
    for v in values:
        aggs.append(F.count(F.when(name == v, F.lit(1))).alias(f"_p_{v}"))
        aggs.append(F.avg(F.when(name == v, nan_to_null(F.col(values_from)))).alias(f"_v_{v}"))
    wide = df.groupBy(*id_cols).agg(*aggs)
    out = [F.col(c) for c in id_cols]
    for v in values:
        filled = F.col(f"_v_{v}") if fill is None else F.when(
            F.col(f"_p_{v}") == 0, F.lit(float(fill))).otherwise(F.col(f"_v_{v}"))
        if on_duplicate == "error":
            filled = F.when(F.col(f"_p_{v}") > 1, F.raise_error(
                F.lit(f"duplicate rows in a {names_from}={v} cell")).cast("double")
            ).otherwise(filled)
        out.append(filled.alias(v))
    return wide.select(*out)


def _stack_contrasts(wide: DataFrame, keys: Sequence[str], baseline: str,
                     timepoints: Sequence[str]) -> DataFrame:
    """(keys, baseline, tp1, tp2, ...) -> (keys, time_point, x, y) rows, one
    per requested time point; a narrow transformation (no shuffle)."""
    arr = F.array(*[F.struct(F.lit(tp).alias("time_point"), nan_to_null(F.col(baseline)).alias("x"),
                             nan_to_null(F.col(tp)).alias("y")) for tp in timepoints])
    return wide.select(*keys, F.inline(arr))


def paired_t(wide: DataFrame, *, feature: str = "metabolite", baseline: str = "Day0",
             timepoints: Sequence[str] = ("Day10", "Day20"), alpha: float = 0.05,
             by: Sequence[str] = ()) -> DataFrame:
    """M4: paired t-test baseline vs each time point, per feature.

    d = baseline - time point over rows where both are present;
    statistic = mean(d) / (sd(d) / sqrt(n)), df = n - 1. All time points are
    computed in one aggregation.
    """
    long = _stack_contrasts(wide, [*by, feature], baseline, timepoints)
    d = F.col("x") - F.col("y")
    mom = long.groupBy(*by, feature, "time_point").agg(
        F.count(d).alias("_n"), F.avg(d).alias("_m"), F.var_samp(d).alias("_v"))
    n, m, v = F.col("_n"), F.col("_m"), F.col("_v")
    se = F.sqrt(v / n)
    status = (F.when(n < 2, F.lit("not_enough_x"))
              .when((se <= 0) | (se < 10 * DOUBLE_EPS * F.abs(m)), F.lit("constant"))
              .otherwise(F.lit("ok")))
    return _finish(mom, [*by, feature, "time_point"], estimate=m, stderr=se,
                   dof=(n - 1).cast("double"), status=status, method=PAIRED_METHOD, alpha=alpha)


def unpaired_t(wide: DataFrame, *, feature: str = "metabolite", baseline: str = "Day0",
               timepoints: Sequence[str] = ("Day10", "Day20"), alpha: float = 0.05,
               by: Sequence[str] = ()) -> DataFrame:
    """M5: Welch t-test of two wide columns (baseline vs each time point),
    missing values removed per column."""
    long = _stack_contrasts(wide, [*by, feature], baseline, timepoints)
    x, y = F.col("x"), F.col("y")
    mom = long.groupBy(*by, feature, "time_point").agg(
        F.count(x).alias("_n0"), F.avg(x).alias("_m0"), F.var_samp(x).alias("_v0"),
        F.count(y).alias("_n1"), F.avg(y).alias("_m1"), F.var_samp(y).alias("_v1"))
    est, se, dof, status = _welch_from_moments(
        F.col("_n0"), F.col("_m0"), F.col("_v0"), F.col("_n1"), F.col("_m1"), F.col("_v1"))
    return _finish(mom, [*by, feature, "time_point"], estimate=est, stderr=se, dof=dof,
                   status=status, method=WELCH_METHOD, alpha=alpha)
