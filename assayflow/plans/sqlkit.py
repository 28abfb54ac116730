"""SQL text builders for the DuckDB oracle twins of the registered queries.

These only produce reference SQL for cross-checking; Spark never parses
them. Kept next to the query registry so every Spark query has its
independent re-statement in plain SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from assayflow.functions.tdist import sql_t_critical, sql_t_two_sided_p
from assayflow.operators.report import sql_round

EPS = "2.220446049250313e-16"


def r(expr: str) -> str:
    return sql_round(expr)


def welch_moments(cond0: str, cond1: str, value: str) -> str:
    return (f"count(CASE WHEN {cond0} THEN {value} END) AS n0, "
            f"avg(CASE WHEN {cond0} THEN {value} END) AS m0, "
            f"var_samp(CASE WHEN {cond0} THEN {value} END) AS v0, "
            f"count(CASE WHEN {cond1} THEN {value} END) AS n1, "
            f"avg(CASE WHEN {cond1} THEN {value} END) AS m1, "
            f"var_samp(CASE WHEN {cond1} THEN {value} END) AS v1")


def welch_parts(nother: str | None = None) -> dict[str, str]:
    """est/se/dof/status over columns n0 m0 v0 n1 m1 v1."""
    se = "sqrt(v0 / n0 + v1 / n1)"
    dof = ("((v0 / n0 + v1 / n1) * (v0 / n0 + v1 / n1)) / "
           "((v0 / n0) * (v0 / n0) / (n0 - 1) + (v1 / n1) * (v1 / n1) / (n1 - 1))")
    status = (f"CASE WHEN n0 = 0 OR n1 = 0 THEN 'need_two_groups' "
              f"WHEN n0 < 2 THEN 'not_enough_x' WHEN n1 < 2 THEN 'not_enough_y' "
              f"WHEN {se} <= 0 OR {se} < 10 * {EPS} * greatest(abs(m0), abs(m1)) THEN 'constant' "
              f"ELSE 'ok' END")
    if nother:
        status = f"CASE WHEN {nother} > 0 THEN 'need_two_groups' ELSE {status} END"
    return {"est": "m0 - m1", "se": se, "dof": dof, "status": status}


def ttest_finish(src: str, keys: Sequence[str], *, est: str, se: str, dof: str,
                 status: str, method: str, extra: Sequence[tuple[str, str]] = (),
                 alpha: float = 0.05, rounded: bool = True) -> str:
    r = sql_round if rounded else (lambda e: f"({e})")
    k = ", ".join(keys)
    extra_in = "".join(f", {e} AS {n}" for e, n in extra)
    extra_out = "".join(f", {r(n)} AS {n}" for _, n in extra)
    inner = (f"SELECT {k}, {est} AS est, {se} AS se, {dof} AS dfree, {status} AS status{extra_in} "
             f"FROM {src}")
    mid = (f"SELECT *, CASE WHEN status = 'ok' THEN est / se END AS stat, "
           f"CASE WHEN status = 'ok' THEN {sql_t_critical('dfree', alpha)} END AS crit "
           f"FROM ({inner}) i")
    return (f"SELECT {k}, {r('est')} AS estimate{extra_out}, {r('stat')} AS statistic, "
            f"{r(f'CASE WHEN status = {chr(39)}ok{chr(39)} THEN {sql_t_two_sided_p("stat", "dfree")} END')} AS p_value, "
            f"{r(f'CASE WHEN status = {chr(39)}ok{chr(39)} THEN dfree END')} AS parameter, "
            f"{r('est - crit * se')} AS conf_low, {r('est + crit * se')} AS conf_high, "
            f"'{method}' AS method, 'two.sided' AS alternative, status "
            f"FROM ({mid}) m")


def ols_sql(src: str, ivs: Sequence[str], *, categorical: str | None = None,
            numeric: Sequence[str] = (), alpha: float = 0.05, rounded: bool = True,
            by: Sequence[str] = ()):
    """Oracle OLS: centred sums (within ``categorical`` when given), solved by
    elimination for any number of slope terms. ``src`` has feature_label, level, the
    covariates and the independent variables (time point already applied)."""
    r = sql_round if rounded else (lambda e: f"({e})")
    bk = "".join(f"{b}, " for b in by)
    covs = ([categorical] if categorical else []) + list(numeric)
    names = [*numeric, "x"]
    allv = [*names, "level"]
    pairs = [(a, b) for i, a in enumerate(allv) for b in allv[i:]]
    al = {(a, b): f"S_{a}__{b}" for a, b in pairs}
    al.update({(b, a): v for (a, b), v in list(al.items())})
    cov_sel = "".join(f", cast({c} AS double) AS {c}" if c in numeric else f", {c}" for c in covs)
    unp = " UNION ALL ".join(
        f"SELECT {bk}feature_label, level{cov_sel}, '{iv}' AS independent_variable, "
        f"cast({iv} AS double) AS x FROM {src}" for iv in ivs)
    notnull = " AND ".join(["x IS NOT NULL", "NOT isnan(x)", "x <> 0", "level IS NOT NULL"]
                           + [f"{c} IS NOT NULL" for c in covs])
    sums = ", ".join(f"regr_sxy({b}, {a}) AS {al[(a, b)]}" for a, b in pairs)
    if categorical:
        s1 = (f"SELECT {bk}feature_label, independent_variable, {categorical}, count(*) AS n, {sums} "
              f"FROM unp WHERE {notnull} GROUP BY {bk}feature_label, independent_variable, {categorical}")
        s2 = (f"SELECT {bk}feature_label, independent_variable, cast(sum(n) AS BIGINT) AS n, count(*) AS k, "
              + ", ".join(f"sum({al[p]}) AS {al[p]}" for p in pairs)
              + f" FROM s1 GROUP BY {bk}feature_label, independent_variable")
        intercepts = "k"
    else:
        s1 = (f"SELECT {bk}feature_label, independent_variable, count(*) AS n, {sums} "
              f"FROM unp WHERE {notnull} GROUP BY {bk}feature_label, independent_variable")
        s2 = "SELECT * FROM s1"
        intercepts = "1"
    # one variable after the other is eliminated; one that is a combination of
    # those before it is passed over and takes no degree of freedom
    m = len(names)
    steps = {"e0": "SELECT *, 0 AS rank0, " + ", ".join(
        f"{al[(allv[i], allv[j])]} AS c0_{i}_{j}" for i in range(m + 1) for j in range(i, m + 1)) + " FROM s2"}
    for k in range(m):
        whole = al[(names[k], names[k])]
        own = f"({whole} > 0 AND c{k}_{k}_{k} > 1e-12 * {whole})"
        steps[f"e{k + 1}"] = (
            f"SELECT *, rank{k} + CASE WHEN {own} THEN 1 ELSE 0 END AS rank{k + 1}, " + ", ".join(
                f"CASE WHEN {own} THEN c{k}_{i}_{j} - c{k}_{k}_{i} * c{k}_{k}_{j} / c{k}_{k}_{k} "
                f"ELSE c{k}_{i}_{j} END AS c{k + 1}_{i}_{j}"
                for i in range(k + 1, m + 1) for j in range(i, m + 1)) + f" FROM e{k}")
    left = f"c{m - 1}_{m - 1}_{m - 1}"
    ok = f"(rank{m} > rank{m - 1} AND dfree > 0)"
    b = f"c{m - 1}_{m - 1}_{m} / {left}"
    se = f"sqrt(greatest(c{m}_{m}_{m}, 0.0) / dfree / {left})"
    fitq = (f"SELECT {bk}feature_label, independent_variable, n, dfree, "
            f"CASE WHEN {ok} THEN {b} END AS b, CASE WHEN {ok} THEN {se} END AS se "
            f"FROM (SELECT *, cast(n - {intercepts} - rank{m} AS double) AS dfree FROM e{m}) q")
    fin = (f"SELECT *, b / se AS t, CASE WHEN se IS NOT NULL THEN {sql_t_critical('dfree', alpha)} END AS crit "
           f"FROM fit")
    body = (f"SELECT {bk}feature_label, independent_variable, "
            f"{r(f'CASE WHEN se IS NOT NULL THEN {sql_t_two_sided_p("t", "dfree")} END')} AS LR_P_Value, "
            f"{r('b')} AS LR_Effect_Size, {r('b - crit * se')} AS LR_CI_Lower, "
            f"{r('b + crit * se')} AS LR_CI_Upper, n, {r('dfree')} AS df, {r('se')} AS std_err, "
            f"{r('t')} AS t_stat FROM fin")
    return body, {"unp": unp, "s1": s1, "s2": s2, **steps, "fit": fitq, "fin": fin}


def bh_sql(src: str, *, p: str, by: Sequence[str], order_key: str) -> str:
    """Oracle BH: plain windows over each contrast (ties need no order)."""
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    ranked = (f"SELECT *, row_number() OVER ({part} ORDER BY {p}, {order_key}) AS _rk, "
              f"count({p}) OVER ({part}) AS _m FROM {src} WHERE {p} IS NOT NULL")
    adj = (f"SELECT *, least(1.0, min({p} * _m / _rk) OVER ({part} ORDER BY _rk DESC "
           f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_bh FROM ({ranked}) q")
    keys = " AND ".join([f"s.{b} = a.{b}" for b in by] + [f"s.{order_key} = a.{order_key}"])
    return (f"SELECT s.*, a.p_bh FROM {src} s LEFT JOIN ({adj}) a ON {keys}")


def median_pivot_sql(src: str, *, keys: Sequence[str], group: str, value: str,
                     groups: Sequence, labels: Sequence[str]) -> str:
    k = ", ".join(keys)
    med = f"SELECT {k}, {group}, median({value}) AS _med FROM {src} GROUP BY {k}, {group}"
    cols = ", ".join(f"max(CASE WHEN {group} = {g!r} THEN _med END) AS {lbl}"
                     for g, lbl in zip(groups, labels))
    return f"SELECT {k}, {cols} FROM ({med}) m GROUP BY {k}"


def fc_cols(num: str, den: str) -> str:
    fc = f"(CASE WHEN {den} <> 0 THEN {num} / {den} END)"
    return f"{fc} AS fold_change, CASE WHEN {fc} > 0 THEN log2({fc}) END AS log2_fold_change"
