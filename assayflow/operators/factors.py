"""Least squares beside several categorical covariates, from cell sums.

The rows are reduced once, to one row per (model, combination of levels). The
factor with the most levels is absorbed: counts and sums are centred within its
levels. The levels of the other factors and the slopes stay as the unknowns of
one symmetric system per model, whose size is that of the smaller factors; it
is eliminated in place by higher-order functions, in the order levels,
covariates, x.

No level is left out as a reference: an unknown that is a combination of those
before it has nothing left when its turn comes and is passed over. So empty
cells, levels seen once and designs that fall apart into unconnected blocks
need no case of their own, and the unknowns that were not passed over are the
rank. A residual sum of squares below ``ROUNDING`` of the total is zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayflow.session import written

#: Share of a variable's sum of squares below which nothing of it is left.
SINGULAR_RTOL = 1e-12
#: Share of the level's sum of squares that is rounding.
ROUNDING = 1e-13


def eliminate_factors(long: DataFrame, keys: Sequence[str], factors: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, _n, _df, _beta_x, _rss, _left) of ``level ~ factors + names``
    per key; the last of ``names`` is x. _beta_x and _rss are NULL where x is
    not estimable or no degree of freedom is left."""
    cells = written(_cells(long, keys, factors, names), "cells")
    levels = cells.agg(*[F.approx_count_distinct(f) for f in factors]).first()
    widest = max(zip(levels, factors), key=lambda p: p[0])[1]
    others = [f for f in factors if f != widest]
    entries, totals = _entries(cells, keys, widest, others, names)
    solved = _eliminate(entries, keys).join(
        totals.select(F.struct(*keys).alias("_key"), "_n", "_k", "_syy"), "_key")
    solved = solved.withColumn("_df", (F.col("_n") - F.col("_k") - F.col("_e.rank") - 1).cast("double"))
    row = lambda i, j: F.get(F.get("_e.m", F.col("_p") - i), F.col("_p") - j)
    solved = solved.withColumns({"_left": row(2, 2), "_sxy": row(2, 1), "_syy_left": row(1, 1)})
    ok = (F.col("_left") > SINGULAR_RTOL * F.get("_refs", F.col("_p") - 2)) & (F.col("_df") > 0)
    rss = F.col("_syy_left") - F.col("_sxy") * F.col("_sxy") / F.col("_left")
    return solved.select(
        *[F.col(f"_key.{k}").alias(k) for k in keys], "_n", "_df",
        F.when(ok, F.col("_sxy") / F.col("_left")).alias("_beta_x"),
        F.when(ok, F.when(rss > ROUNDING * F.col("_syy"), rss).otherwise(F.lit(0.0))).alias("_rss"),
        F.when(ok, F.col("_left")).alias("_left"))


def _cells(long: DataFrame, keys: Sequence[str], factors: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Count, means and centred cross products per key and level combination."""
    variables = [*names, "level"]
    return long.groupBy(*keys, *factors).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(v).alias(f"_m{i}") for i, v in enumerate(variables)],
        *[F.regr_sxy(b, a).alias(f"_s{i}_{j}") for i, a in enumerate(variables)
          for j, b in enumerate(variables) if i <= j])


def _entries(cells: DataFrame, keys: Sequence[str], widest: str, others: Sequence[str],
             names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The systems as rows (_key, i, j, v, ref), ref being the size that what
    is left of unknown i is held against; and the totals per key."""
    at = range(len(names) + 1)
    label = lambda i: F.struct(F.lit(len(others) + i).alias("at"), F.lit("").alias("level"))
    own = Window.partitionBy(*keys, widest)
    cells = cells.withColumn("_of", F.sum("_n").over(own)).withColumns(
        {f"_d{i}": F.col(f"_m{i}") - F.sum(F.col("_n") * F.col(f"_m{i}")).over(own) / F.col("_of") for i in at})
    cells = cells.withColumns({"_key": F.struct(*keys), "_in": F.struct(*keys, widest), "_levels": F.array(*[
        F.struct(F.lit(i).alias("at"), F.col(f).cast("string").alias("level")) for i, f in enumerate(others)])})

    # slopes and level among themselves
    within = cells.groupBy(*keys, widest).agg(F.sum("_n").alias("_n"), *[
        F.sum(F.col(f"_s{i}_{j}") + F.col("_n") * F.col(f"_d{i}") * F.col(f"_d{j}")).alias(f"_t{i}_{j}")
        for i in at for j in at if i <= j], *[
        F.sum(F.col("_n") * F.col(f"_m{i}")).alias(f"_sum{i}") for i in at], *[
        F.sum(F.col(f"_s{i}_{i}") + F.col("_n") * F.col(f"_m{i}") * F.col(f"_m{i}")).alias(f"_sq{i}") for i in at])
    totals = within.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_n"),
        *[F.sum(f"_t{i}_{j}").alias(f"_t{i}_{j}") for i in at for j in at if i <= j],
        *[(F.sum(f"_sq{i}") - F.sum(f"_sum{i}") * F.sum(f"_sum{i}") / F.sum("_n")).alias(f"_ref{i}") for i in at])
    totals = totals.withColumn("_syy", F.col(f"_t{at[-1]}_{at[-1]}"))

    def entry(i, j, v, ref=None):
        return F.struct(i.alias("i"), j.alias("j"), v.alias("v"),
                        (F.lit(None).cast("double") if ref is None else ref).alias("ref"))

    slopes = totals.select(F.struct(*keys).alias("_key"), F.explode(F.array(*[
        entry(label(i), label(j), F.col(f"_t{min(i, j)}_{max(i, j)}"), F.col(f"_ref{i}") if i == j else None)
        for i in at for j in at])).alias("e")).select("_key", "e.*")

    # rows that two levels share
    n = F.col("_n").cast("double")
    shared = (cells.select("_key", "_n", "_levels", F.explode("_levels").alias("i"))
              .select("_key", "_n", "i", F.explode("_levels").alias("j"))
              .groupBy("_key", "i", "j").agg(F.sum(n).alias("v"))
              .withColumn("ref", F.when(F.col("i") == F.col("j"), F.col("v"))))
    # less what the absorbed factor explains of them; the pairs are those of
    # the smaller factors' levels, which are unknowns of the system
    inside = cells.select("_key", "_in", "_of", "_n", *[f"_d{i}" for i in at], F.explode("_levels").alias("i"))
    inside = inside.groupBy("_key", "_in", "i").agg(
        F.sum(n).alias("_c"), F.max("_of").alias("_of"),
        *[F.sum(F.col("_n") * F.col(f"_d{i}")).alias(f"_r{i}") for i in at])
    right = inside.select("_in", F.col("i").alias("j"), F.col("_c").alias("_cj"))
    absorbed = (inside.join(right, "_in").groupBy("_key", "i", "j")
                .agg((-F.sum(F.col("_c") * F.col("_cj") / F.col("_of"))).alias("v"))
                .withColumn("ref", F.lit(None).cast("double")))
    sums = inside.groupBy("_key", "i").agg(*[F.sum(f"_r{v}").alias(f"_r{v}") for v in at])
    crossed = sums.select("_key", F.explode(F.array(
        *[entry(F.col("i"), label(v), F.col(f"_r{v}")) for v in at],
        *[entry(label(v), F.col("i"), F.col(f"_r{v}")) for v in at])).alias("e")).select("_key", "e.*")
    rows = slopes.unionByName(shared).unionByName(absorbed).unionByName(crossed)
    return rows.groupBy("_key", "i", "j").agg(F.sum("v").alias("v"), F.max("ref").alias("ref")), totals


def _eliminate(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(_key, _p, _refs, _e): the system after all unknowns but x, and how
    many of them had something left."""
    lines = entries.groupBy("_key", "i").agg(
        F.max("ref").alias("ref"), F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("line"))
    systems = lines.groupBy("_key").agg(F.collect_list(F.struct("i", "ref", "line")).alias("_lines"))
    systems = systems.withColumn("_lines", F.array_sort(
        "_lines", lambda a, b: F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)))
    systems = systems.select(
        "_key", F.size("_lines").alias("_p"), F.transform("_lines", lambda r: r["ref"]).alias("_refs"),
        F.transform("_lines", lambda r: F.transform(
            F.col("_lines"), lambda c: F.coalesce(F.element_at(r["line"], c["i"]), F.lit(0.0)))).alias("_m"))

    def step(state, k):
        m = state["m"]
        pivot = F.get(F.get(m, k), k)
        less = F.transform(m, lambda r, i: F.when(i <= k, r).otherwise(F.transform(
            r, lambda v, j: v - F.get(r, k) / pivot * F.get(F.get(m, k), j))))
        return F.when(pivot > SINGULAR_RTOL * F.get("_refs", k),
                      F.struct(less.alias("m"), (state["rank"] + 1).alias("rank"))).otherwise(state)

    start = F.struct(F.col("_m").alias("m"), F.lit(0).alias("rank"))
    return systems.select("_key", "_p", "_refs", F.aggregate(
        F.sequence(F.lit(0), F.col("_p") - 3), start, step).alias("_e"))
