"""Student-t tail probability and quantile as native column expressions (X11).

Spark has no t CDF, but the regularized incomplete beta function of
commons-math3 (shipped on Spark's own classpath) is reachable through the
public SQL function ``reflect``; no Python worker is involved:

    P(|T| > t) = I_{nu/(nu+t^2)}(nu/2, 1/2)

The quantile is found by bisection on u in (0, 1) with t = u / (1 - u),
expressed as a higher-order ``aggregate`` over ``sequence(1, steps)``.

``reflect`` is non-deterministic to Catalyst: use these expressions in
projections over one-row-per-feature results, never inside an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BETA_CLASS = "org.apache.commons.math3.special.Beta"


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def _reg_beta(x: Column, a: Column, b: float) -> Column:
    # Arguments are always non-null doubles here; guards live in callers.
    return F.reflect(
        F.lit(_BETA_CLASS), F.lit("regularizedBeta"),
        x.cast("double"), a.cast("double"), F.lit(float(b)),
    ).cast("double")


def _two_sided_unguarded(t: Column, df: Column) -> Column:
    x = df / (df + t * t)
    return _reg_beta(x, df / 2.0, 0.5)


def _sql_ref(x) -> str | None:
    """SQL text for a column name or a number; None for other Columns."""
    if isinstance(x, str):
        return "`" + x.replace("`", "``") + "`"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"CAST({float(x)!r} AS DOUBLE)"
    return None


def _reflect_sql(t: str, df: str) -> str:
    return (f"CAST(reflect('{_BETA_CLASS}', 'regularizedBeta', CAST({df} / ({df} + {t} * {t}) AS DOUBLE), "
            f"CAST({df} / 2 AS DOUBLE), CAST(0.5 AS DOUBLE)) AS DOUBLE)")


def t_two_sided_p(t, df) -> Column:
    """Two-sided p-value P(|T_df| > |t|).

    NULL when t or df is NULL/NaN or df <= 0; 1 when t == 0; 0 when |t| is
    infinite. Column names / numbers are turned into one SQL expression
    (one parse instead of many expression-building calls).
    """
    ts, ds = _sql_ref(t), _sql_ref(df)
    if ts is not None and ds is not None:
        t_, d_ = f"CAST({ts} AS DOUBLE)", f"CAST({ds} AS DOUBLE)"
        return F.expr(
            f"CASE WHEN {t_} IS NULL OR {d_} IS NULL OR isnan({t_}) OR isnan({d_}) OR {d_} <= 0 "
            f"THEN CAST(NULL AS DOUBLE) WHEN {t_} = 0 THEN CAST(1.0 AS DOUBLE) "
            f"WHEN abs({t_}) = double('inf') THEN CAST(0.0 AS DOUBLE) "
            f"ELSE {_reflect_sql(t_, d_)} END")
    t, df = _c(t).cast("double"), _c(df).cast("double")
    bad = t.isNull() | df.isNull() | F.isnan(t) | F.isnan(df) | (df <= 0)
    safe_t = F.when(bad, F.lit(1.0)).otherwise(t)
    safe_df = F.when(bad, F.lit(1.0)).otherwise(df)
    return (
        F.when(bad, F.lit(None).cast("double"))
        .when(t == 0, F.lit(1.0))
        .when(F.abs(t) == float("inf"), F.lit(0.0))
        .otherwise(_two_sided_unguarded(safe_t, safe_df))
    )


def t_critical(df, alpha: float = 0.05, steps: int = 60) -> Column:
    """Two-sided critical value c with P(|T_df| > c) = alpha
    (i.e. the (1 - alpha/2) quantile). NULL when df is NULL or <= 0."""
    ds = _sql_ref(df)
    if ds is not None:
        d_ = f"CAST({ds} AS DOUBLE)"
        mid = "((acc__.lo + acc__.hi) / 2)"
        tail = _reflect_sql(f"({mid} / (1 - {mid}))", d_)
        return F.expr(
            f"CASE WHEN {d_} IS NULL OR isnan({d_}) OR {d_} <= 0 THEN CAST(NULL AS DOUBLE) ELSE "
            f"aggregate(sequence(1, {int(steps)}), named_struct('lo', CAST(0.0 AS DOUBLE), "
            f"'hi', CAST(1.0 AS DOUBLE)), (acc__, i__) -> IF({tail} > {float(alpha)!r}, "
            f"named_struct('lo', {mid}, 'hi', acc__.hi), named_struct('lo', acc__.lo, 'hi', {mid})), "
            f"acc__ -> {mid} / (1 - {mid})) END")
    df = _c(df).cast("double")
    bad = df.isNull() | F.isnan(df) | (df <= 0)
    safe_df = F.when(bad, F.lit(1.0)).otherwise(df)
    init = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(acc, _i):
        mid = (acc["lo"] + acc["hi"]) / 2.0
        tail = _two_sided_unguarded(mid / (1.0 - mid), safe_df)
        return F.when(
            tail > F.lit(float(alpha)),
            F.struct(mid.alias("lo"), acc["hi"].alias("hi")),
        ).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

    def finish(acc):
        mid = (acc["lo"] + acc["hi"]) / 2.0
        return mid / (1.0 - mid)

    q = F.aggregate(F.sequence(F.lit(1), F.lit(int(steps))), init, step, finish)
    return F.when(bad, F.lit(None).cast("double")).otherwise(q)


# --- DuckDB oracle twins -------------------------------------------------
# DuckDB has no incomplete beta either. The oracle evaluates
#   P(|T| > t) = I_x(nu/2, 1/2),  x = nu / (nu + t^2)
# with the classic continued fraction for the regularized incomplete beta
# (modified Lentz iteration, fixed number of steps, via list_reduce) and the
# lgamma prefactor; for x beyond the mean it uses I_x(a, b) = 1 - I_{1-x}(b, a).

_CF_STEPS = 80
_TINY = "1e-300"


def _g(v: str) -> str:
    return f"(CASE WHEN abs({v}) < {_TINY} THEN {_TINY} ELSE {v} END)"


def _sql_betacf(x: str, a: str, b: str, steps: int = _CF_STEPS) -> str:
    """Continued fraction of I_x(a, b) by half-steps k = 1..2*steps: the
    state keeps the running product without the current (c, d), so every
    term is evaluated once per step."""
    m = "((k + 1) // 2)"
    aa = (f"(CASE WHEN k % 2 = 1 THEN {m} * ({b} - {m}) * {x} / (({a} - 1 + 2 * {m}) * ({a} + 2 * {m})) "
          f"ELSE -({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 1 + 2 * {m})) END)")
    d0 = f"(1 / {_g(f'1 - ({a} + {b}) * {x} / ({a} + 1)')})"
    init = f"{{'c': 1.0::DOUBLE, 'd': {d0}, 'h': 1.0::DOUBLE}}"
    step = (f"lambda s, k: {{'c': {_g(f'1 + {aa} / s.c')}, 'd': 1 / {_g(f'1 + {aa} * s.d')}, "
            f"'h': s.h * s.c * s.d}}")
    return f"list_transform([list_reduce(range(1, 2 * {steps} + 1), {step}, {init})], lambda r: r.h * r.c * r.d)[1]"


def _sql_ibeta(x: str, a: str, b: str) -> str:
    """Regularized incomplete beta I_x(a, b) for 0 < x < 1."""
    front = (f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) "
             f"+ {b} * ln(1 - {x}))")
    direct = f"({front} * {_sql_betacf(x, a, b)} / {a})"
    swapped = f"(1 - {front} * {_sql_betacf(f'(1 - {x})', b, a)} / {b})"
    return (f"(CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 "
            f"WHEN {x} < ({a} + 1) / ({a} + {b} + 2) THEN {direct} ELSE {swapped} END)")


def _sql_tail_unguarded(t: str, nu: str) -> str:
    x = f"(({nu}) / (({nu}) + ({t}) * ({t})))"
    return _sql_ibeta(x, f"(({nu}) / 2)", "0.5")


def sql_t_two_sided_p(t: str, nu: str) -> str:
    return (f"(CASE WHEN ({t}) IS NULL OR ({nu}) IS NULL OR ({nu}) <= 0 THEN NULL "
            f"WHEN ({t}) = 0 THEN 1.0 "
            f"WHEN isinf({t}) THEN 0.0 "
            f"ELSE {_sql_tail_unguarded(t, nu)} END)")


def sql_t_critical(nu: str, alpha: float = 0.05, steps: int = 60) -> str:
    mid = "((a.lo + a.hi) / 2)"
    tail = _sql_tail_unguarded(f"({mid} / (1 - {mid}))", nu)
    red = (f"list_reduce(range({steps}), lambda a, i: CASE WHEN {tail} > {alpha} "
           f"THEN {{'lo': {mid}, 'hi': a.hi}} ELSE {{'lo': a.lo, 'hi': {mid}}} END, "
           f"{{'lo': 0.0::DOUBLE, 'hi': 1.0::DOUBLE}})")
    fin = "lambda r: (r.lo + r.hi) / 2 / (1 - (r.lo + r.hi) / 2)"
    return (f"(CASE WHEN ({nu}) IS NULL OR ({nu}) <= 0 THEN NULL ELSE "
            f"list_transform([{red}], {fin})[1] END)")
