"""Per-feature ordinary least squares (M1), variable sweep (M2) and the
multi-covariate case (U1), from native aggregates.

Model per feature (and independent variable):

    level ~ [site dummies | numeric covariates...] + x

Instead of shipping every feature's rows to a Python worker (a grouped-map
function holds a whole feature in one task), the fit is computed from
centred cross-product sums:

* one categorical covariate is absorbed: ``regr_*`` sums are taken per
  (feature, variable, site) - centring within site is exactly the dummy
  coding - and then added up over sites (two small aggregations; the first
  one is partial/map-side, so a hot feature or site never lands whole in
  one task);
* several categorical covariates are reduced to cell sums, one of them is
  absorbed and the levels of the others are eliminated (``factors``);
* numeric covariates enter the cross-product matrix.

The normal equations are solved by symmetric elimination, one slope per
projection, for any number of slopes, JVM side. Elimination reveals the rank:
a covariate whose sum of squares, after the variables before it are
eliminated, falls to ``SINGULAR_RTOL`` of what it was is a combination of them;
it takes no part and no degree of freedom. x comes last, so its slope, error
and degrees of freedom are those of a pseudo-inverse fit, and only an x that is
such a combination itself has none. Where a fit explains nearly all of the
variance the residual sum of squares cancels, so for those features alone it
is summed again from the rows' residuals.

The sweep over independent variables is one job: variables are unpivoted
into ``(independent_variable, x)`` rows and become a grouping key.

Semantics kept from the original notebooks: rows with x == 0 are dropped
before fitting (``exclude_zero``), rows with any missing (NULL or NaN) model variable
are dropped, degenerate fits (x not estimable beside the covariates, df <= 0)
give NULL results rather than an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from assayflow.functions.tdist import t_critical, t_two_sided_p
from assayflow.operators.factors import SINGULAR_RTOL, eliminate_factors
from assayflow.operators.joins import join_contrast_table
from assayflow.session import written

RESULT_COLUMNS = ["feature_label", "independent_variable", "LR_P_Value", "LR_Effect_Size",
                  "LR_CI_Lower", "LR_CI_Upper"]

# Share of the variance left below which residuals are summed from the rows.
CANCELLED = 1e-9


def _is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NumericType)


def regression_input(df: DataFrame, independent_variables: Sequence[str], *,
                     feature: str = "feature_label", level: str = "level",
                     covariates: Sequence[str] = (), time_point: str | None = None,
                     time_col: str = "time_point", exclude_zero: bool = True,
                     by: Sequence[str] = ()) -> DataFrame:
    """Project, filter the time point, unpivot the independent
    variables into (independent_variable, x) and keep complete rows.

    The time-point filter sits below the unpivot, so it reaches the scan."""
    if time_point is not None:
        df = df.filter(F.col(time_col) == F.lit(time_point))
    cols = [F.col(b) for b in by]
    cols += [F.col(feature).alias("feature_label"), F.col(level).cast("double").alias("level")]
    cols += [F.col(c) for c in covariates]
    cols += [F.col(v).cast("double").alias(v) for v in independent_variables]
    narrow = df.select(*cols)
    long = narrow.unpivot([*by, "feature_label", "level", *covariates],
                          list(independent_variables), "independent_variable", "x")
    keep = F.col("x").isNotNull() & ~F.isnan("x") & F.col("level").isNotNull() & ~F.isnan("level")
    if exclude_zero:
        keep = keep & (F.col("x") != 0)
    for c in covariates:
        keep = keep & F.col(c).isNotNull()
        if isinstance(df.schema[c].dataType, (DoubleType, FloatType)):
            keep = keep & ~F.isnan(c)
    return long.filter(keep)


def _pair_sums(names: Sequence[str]) -> list[tuple[str, str, str]]:
    """(alias, a, b) for every unordered pair of model variables incl. y."""
    allv = [*names, "level"]
    out = []
    for i, a in enumerate(allv):
        for b in allv[i:]:
            out.append((f"_S_{a}__{b}", a, b))
    return out


def _centered(a: str, b: str) -> Column:
    # regr_sxy(y, x) = sum((x - mean x) * (y - mean y)) over complete pairs.
    return F.regr_sxy(F.col(b), F.col(a))


def fit(long: DataFrame, *, categorical: str | Sequence[str] | None = None,
        numeric_covariates: Sequence[str] = (), alpha: float = 0.05,
        details: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Fit per (by..., feature_label, independent_variable) on the output of
    ``regression_input``."""
    keys = [*by, "feature_label", "independent_variable"]
    names = [*numeric_covariates, "x"]
    factors = [categorical] if isinstance(categorical, str) else list(categorical or ())
    if len(factors) > 1:
        solved = written(eliminate_factors(long, keys, factors, names), "fits")
    else:
        solved = _fit_slopes(long, keys, names, factors[0] if factors else None)
    solved = solved.select(*keys, "_n", "_df", F.col("_beta_x").alias("_b"),
                           F.sqrt(F.col("_rss") / F.col("_df") / F.col("_left")).alias("_se"))
    return _report(solved, keys, alpha, details, by)


def _fit_slopes(long: DataFrame, keys: list[str], names: Sequence[str], categorical: str | None) -> DataFrame:
    """(keys, _n, _df, _beta_x, _rss, _left) with at most one factor."""
    pairs = _pair_sums(names)
    if categorical is not None:
        per_site = long.groupBy(*keys, categorical).agg(
            F.count(F.lit(1)).alias("_n"),
            *[_centered(a, b).alias(al) for al, a, b in pairs])
        sums = per_site.groupBy(*keys).agg(
            F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_k"),  # intercept and dummies
            *[F.sum(al).alias(al) for al, _, _ in pairs])
    else:
        sums = long.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.lit(1).alias("_k"),
            *[_centered(a, b).alias(al) for al, a, b in pairs])

    index = {}
    for al, p, q in pairs:
        index[(p, q)] = index[(q, p)] = al

    solved = _eliminated(sums, names, index)
    solved = solved.withColumn("_df", (F.col("_n") - F.col("_k") - F.col("_rank")).cast("double"))
    ok = (F.col("_df") > 0) & F.col("_estimable")
    solved = solved.select(
        *keys, "_n", "_df", *[F.when(ok, F.col(f"_beta_{v}")).alias(f"_beta_{v}") for v in names],
        F.when(ok, F.greatest("_rss", F.lit(0.0))).alias("_rss"), "_syy", "_left")
    solved = written(solved, "fits")
    near = solved.filter(F.col("_rss") <= CANCELLED * F.col("_syy"))
    if near.limit(1).count():
        again = _residual_sums(long, near, keys, names, categorical)
        solved = solved.join(again, keys, "left").withColumn("_rss", F.coalesce("_again", "_rss"))
    return solved


def _report(solved: DataFrame, keys: list[str], alpha: float, details: bool, by: Sequence[str]) -> DataFrame:
    """Tests and intervals of (keys, _n, _df, _b, _se)."""
    # t and the critical value are their own columns, so each row runs the
    # bisection once
    # a perfect fit has t = +-inf and p = 0
    exact = (F.col("_se") == 0) & (F.col("_b") != 0)
    solved = (solved.withColumn("_t", F.when(exact, F.signum("_b") * float("inf"))
                                .otherwise(F.try_divide(F.col("_b"), F.col("_se"))))
              .withColumn("_crit", F.when(F.col("_se").isNotNull(), t_critical("_df", alpha))))
    t, crit = F.col("_t"), F.col("_crit")
    out = solved.select(
        *keys,
        F.when(exact, F.lit(0.0)).when(F.col("_se").isNotNull(), t_two_sided_p("_t", "_df")).alias("LR_P_Value"),
        F.col("_b").alias("LR_Effect_Size"),
        (F.col("_b") - crit * F.col("_se")).alias("LR_CI_Lower"),
        (F.col("_b") + crit * F.col("_se")).alias("LR_CI_Upper"),
        F.col("_n").cast("long").alias("n"), F.col("_df").alias("df"),
        F.col("_se").alias("std_err"), t.alias("t_stat"),
    )
    return out if details else out.select(*by, *RESULT_COLUMNS)


def _eliminated(sums: DataFrame, names: Sequence[str], index) -> DataFrame:
    """Slopes, residual sum of squares, and x's sum of squares left, by
    eliminating one slope variable after the other (x is the last)."""
    held = {(a, b): F.col(index[(a, b)]).alias(f"_s_{i}_{j}")
            for i, a in enumerate([*names, "level"]) for j, b in enumerate([*names, "level"]) if i <= j}
    m = len(names)
    cur = sums.select("*", *held.values(), F.lit(0).alias("_rank"), F.col(index[("level", "level")]).alias("_syy"))
    s = lambda i, j: F.col(f"_s_{min(i, j)}_{max(i, j)}")
    for k in range(m):
        # row k stays as it is now: it is what back substitution needs
        whole = F.col(index[(names[k], names[k])])
        cur = cur.withColumn(f"_own_{k}", (whole > 0) & (s(k, k) > SINGULAR_RTOL * whole))
        cur = cur.withColumns({f"_s_{i}_{j}": F.when(F.col(f"_own_{k}"), s(i, j) - s(k, i) * s(k, j) / s(k, k))
                               .otherwise(s(i, j)) for i in range(k + 1, m + 1) for j in range(i, m + 1)}
                              | {"_rank": F.col("_rank") + F.col(f"_own_{k}").cast("int")})
    for k in reversed(range(m)):
        known = s(k, m)
        for j in range(k + 1, m):
            known = known - s(k, j) * F.col(f"_beta_{names[j]}")
        cur = cur.withColumn(f"_beta_{names[k]}", F.when(F.col(f"_own_{k}"), known / s(k, k)).otherwise(F.lit(0.0)))
    return cur.withColumns({"_estimable": F.col(f"_own_{m - 1}"), "_rss": s(m, m), "_left": s(m - 1, m - 1)})


def _residual_sums(long: DataFrame, fits: DataFrame, keys: list[str], names: Sequence[str],
                   categorical: str | None) -> DataFrame:
    """(keys, _again): residual sum of squares of the given fits from the
    rows, centred within the categorical covariate as the fit is."""
    rows = join_contrast_table(long, written(fits.select(*keys, *[f"_beta_{v}" for v in names]), "near"), keys)
    left = F.col("level")
    for v in names:
        left = left - F.col(f"_beta_{v}") * F.col(v)
    within = [*keys, categorical] if categorical is not None else keys
    parts = rows.withColumn("_r", left).groupBy(*within).agg(F.regr_sxx("_r", "_r").alias("_ss"))
    return parts.groupBy(*keys).agg(F.sum("_ss").alias("_again"))


def regress_features(df: DataFrame, independent_variables: Sequence[str], *,
                     covariate: str | Sequence[str] | None = None, numeric_covariates: Sequence[str] = (),
                     feature: str = "feature_label", level: str = "level",
                     time_point: str | None = None, time_col: str = "time_point",
                     exclude_zero: bool = True, alpha: float = 0.05,
                     details: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """M1 + M2: fit ``level ~ covariate + numeric_covariates + x`` for every
    feature and every independent variable in one job. ``by`` adds grouping
    keys (e.g. every time point at once instead of one ``time_point``).

    ``covariate`` is one column or a list; each is dummy-coded when it is a
    string column and enters linearly when numeric (the formula interface's
    behaviour).
    """
    covariates = [covariate] if isinstance(covariate, str) else list(covariate or ())
    categorical = [c for c in covariates if not _is_numeric(df, c)]
    numeric = [*(c for c in covariates if c not in categorical), *numeric_covariates]
    covs = categorical + numeric
    long = regression_input(df, independent_variables, feature=feature, level=level,
                            covariates=covs, time_point=time_point, time_col=time_col,
                            exclude_zero=exclude_zero, by=by)
    for c in numeric:
        long = long.withColumn(c, F.col(c).cast("double"))
    return fit(long, categorical=categorical, numeric_covariates=numeric, alpha=alpha,
               details=details, by=by)
