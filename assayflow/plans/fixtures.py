"""Views over the driver tables that stand in for the study inputs.

Each view exists twice: as a DataFrame builder (what the Spark queries use)
and as SQL text (what the DuckDB oracle inlines as a CTE). The shapes are
those of FIXTURES.md. Every view reads whole tables; its size grows with
the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _visit_label(ts):
    bucket = F.least(F.lit(2), F.floor((F.dayofmonth(ts) - 1) / 10).cast("int"))
    return F.concat(F.lit("Day "), (F.lit(10) * bucket).cast("string"))


def assay_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression input: one row per line item, feature = brand."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(p, li.l_partkey == p.p_partkey)
         .join(c, o.o_custkey == c.c_custkey))
    return j.select(
        F.col("p_brand").alias("metabolite"),
        F.col("o_custkey").cast("string").alias("subject_id"),
        F.year("o_orderdate").cast("string").alias("time_point"),
        F.col("c_mktsegment").alias("site"),
        F.col("c_nationkey").alias("site_num"),
        (F.col("l_extendedprice") / 10000).alias("level"),
        F.col("l_discount").alias("x_discount"),
        (F.col("l_quantity") / 10).alias("x_quantity"),
        (F.col("c_acctbal") / 1000).alias("x_acctbal"),
    )


def visits_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t-test / fold-change input: one row per feature, animal and visit."""
    ev = table(spark, sf_dir, "events")
    return (
        ev.groupBy(
            F.concat(F.lit("serum_"), F.col("event_type"), F.lit(";"),
                     F.substring("event_type", 1, 2)).alias("metabolite"),
            F.col("user_id").cast("string").alias("animal"),
            _visit_label(F.col("ts")).alias("Visit"),
            F.concat(F.lit("T0"), (1 + F.col("user_id") % 3).cast("string")).alias("Treatment"),
            (F.col("user_id") % 2).cast("int").alias("Progressive"),
        )
        .agg((F.avg("value") / 10).alias("level"))
    )


PLANTED_SHIFT = 1.5


def visits_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``visits_long`` with an effect planted in two of its features: higher
    in the progressive group, and rising with the visit."""
    v = visits_long(spark, sf_dir)
    day = F.replace("Visit", F.lit("Day "), F.lit("")).cast("double")
    shift = F.when(F.col("metabolite").isin("serum_click;cl", "serum_view;vi"),
                   F.lit(PLANTED_SHIFT) * F.col("Progressive") + day / 10).otherwise(F.lit(0.0))
    return v.withColumn("level", F.col("level") + shift)


def grand_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprocessing input: wide, mostly-missing feature columns."""
    ev = table(spark, sf_dir, "events")
    et, v = F.col("event_type"), F.col("value")
    return (
        ev.groupBy(
            F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" -"),
                     F.dayofmonth("ts").cast("string")).alias("sample_id"),
            F.col("user_id").cast("string").alias("animal"),
        )
        .agg(
            F.sum(F.when(et == "click", F.floor(v / 20).cast("double"))).alias("serum_click"),
            F.sum(F.when(et == "view", v)).alias("serum_view"),
            F.sum(F.when(et == "signup", v)).alias("serum_signup"),
            F.sum(F.when(et == "purchase", v)).alias("serum_purchase"),
            F.sum(F.when(et == "error", v)).alias("serum_error"),
        )
        .withColumn("serum_empty", F.lit(None).cast("double"))
    )


def targets_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlier / LOD input: target x sample, blanks marked."""
    ev = table(spark, sf_dir, "events")
    blank = (F.col("user_id") % 5) == 0
    main = (
        ev.groupBy(F.col("event_type").alias("target"), F.col("user_id").alias("sample_pos"))
        .agg(F.avg("value").alias("_avg"))
        .select(
            "target", "sample_pos",
            F.col("sample_pos").cast("string").alias("sample"),
            ((F.col("sample_pos") % 5) == 0).alias("is_blank"),
            (F.col("_avg") / F.when((F.col("sample_pos") % 5) == 0, 4).otherwise(1)).alias("level"),
        )
    )
    zero = (
        ev.select("user_id").distinct()
        .select(
            F.lit("zero_target").alias("target"),
            F.col("user_id").alias("sample_pos"),
            F.col("user_id").cast("string").alias("sample"),
            blank.alias("is_blank"),
            F.when(blank, F.lit(1.0)).otherwise(F.lit(0.0)).alias("level"),
        )
    )
    return main.unionByName(zero)


def pheno(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    return ev.select(
        F.nullif(F.col("user_id").cast("string"), F.lit("7")).alias("animal"),
        _visit_label(F.col("ts")).alias("visit_dcf"),
        F.concat(F.lit("T0"), (1 + F.col("user_id") % 3).cast("string")).alias("Treatment"),
        (F.col("user_id") % 2).cast("int").alias("Progressive"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    return ev.select(
        F.nullif(F.col("user_id").cast("string"), F.lit("7")).alias("case_id"),
        _visit_label(F.col("ts")).alias("Visit"),
        F.concat(F.lit("T0"), (1 + F.col("user_id") % 3).cast("string")).alias("treatment_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 F.dayofmonth("ts").cast("string")).alias("custom_id"),
    ).distinct()


DAY_COLUMNS = [f"d{d:02d}" for d in range(1, 32)]


def targets_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cytokine-style assay file: targets in rows, one column per sample
    (here: one column per day of the month)."""
    ev = table(spark, sf_dir, "events")
    dom = F.dayofmonth("ts")
    return ev.groupBy(F.col("event_type").alias("targetName")).agg(
        *[F.avg(F.when(dom == d, F.col("value"))).alias(name)
          for d, name in zip(range(1, 32), DAY_COLUMNS)]
    )


# --- SQL twins (DuckDB oracle) ---------------------------------------------

_VISIT_SQL = ("concat('Day ', cast(10 * least(2, cast(floor((dayofmonth(ts) - 1) / 10) AS int)) "
              "AS string))")

SQL = {
    "assay_long": """
SELECT p.p_brand AS metabolite, cast(o.o_custkey AS string) AS subject_id,
       cast(year(o.o_orderdate) AS string) AS time_point,
       c.c_mktsegment AS site, c.c_nationkey AS site_num,
       l.l_extendedprice / 10000 AS level,
       l.l_discount AS x_discount, l.l_quantity / 10 AS x_quantity, c.c_acctbal / 1000 AS x_acctbal
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey JOIN customer c ON o.o_custkey = c.c_custkey""",
    "visits_long": f"""
SELECT concat('serum_', event_type, ';', substr(event_type, 1, 2)) AS metabolite,
       cast(user_id AS string) AS animal,
       {_VISIT_SQL} AS Visit,
       concat('T0', cast(1 + user_id % 3 AS string)) AS Treatment,
       cast(user_id % 2 AS int) AS Progressive,
       avg(value) / 10 AS level
FROM events GROUP BY 1, 2, 3, 4, 5""",
    "visits_planted": f"""
SELECT metabolite, animal, Visit, Treatment, Progressive,
       level + CASE WHEN metabolite IN ('serum_click;cl', 'serum_view;vi')
               THEN cast({PLANTED_SHIFT} AS double) * Progressive + cast(replace(Visit, 'Day ', '') AS double) / 10
               ELSE cast(0 AS double) END AS level
FROM visits_long""",
    "grand_wide": """
SELECT concat(' ', cast(user_id AS string), ' -', cast(dayofmonth(ts) AS string)) AS sample_id,
       cast(user_id AS string) AS animal,
       sum(CASE WHEN event_type = 'click' THEN cast(floor(value / 20) AS double) END) AS serum_click,
       sum(CASE WHEN event_type = 'view' THEN value END) AS serum_view,
       sum(CASE WHEN event_type = 'signup' THEN value END) AS serum_signup,
       sum(CASE WHEN event_type = 'purchase' THEN value END) AS serum_purchase,
       sum(CASE WHEN event_type = 'error' THEN value END) AS serum_error,
       cast(NULL AS double) AS serum_empty
FROM events GROUP BY 1, 2""",
    "targets_long": """
SELECT event_type AS target, user_id AS sample_pos, cast(user_id AS string) AS sample,
       user_id % 5 = 0 AS is_blank, avg(value) / (CASE WHEN user_id % 5 = 0 THEN 4 ELSE 1 END) AS level
FROM events GROUP BY 1, 2
UNION ALL
SELECT 'zero_target', user_id, cast(user_id AS string), user_id % 5 = 0,
       CASE WHEN user_id % 5 = 0 THEN cast(1 AS double) ELSE cast(0 AS double) END
FROM (SELECT DISTINCT user_id FROM events) u""",
    "pheno": f"""
SELECT nullif(cast(user_id AS string), '7') AS animal,
       {_VISIT_SQL} AS visit_dcf,
       concat('T0', cast(1 + user_id % 3 AS string)) AS Treatment, cast(user_id % 2 AS int) AS Progressive
FROM events WHERE event_type = 'view'""",
    "manifest": f"""
SELECT DISTINCT nullif(cast(user_id AS string), '7') AS case_id,
       {_VISIT_SQL} AS Visit,
       concat('T0', cast(1 + user_id % 3 AS string)) AS treatment_id,
       concat(cast(user_id AS string), '-', cast(dayofmonth(ts) AS string)) AS custom_id
FROM events WHERE event_type = 'click'""",
    "targets_wide": "SELECT event_type AS targetName, " + ", ".join(
        f"avg(CASE WHEN dayofmonth(ts) = {d} THEN value END) AS {name}"
        for d, name in zip(range(1, 32), DAY_COLUMNS)) + " FROM events GROUP BY 1",
}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with CTEs for the named fixture views (and any extra
    CTEs, in order)."""
    ctes = [f"{n} AS ({SQL[n]}\n)" for n in names]
    for k, v in (extra or {}).items():
        ctes.append(f"{k} AS ({v}\n)")
    return "WITH " + ",\n".join(ctes) + "\n" + body
