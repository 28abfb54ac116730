"""Mergeable quantile sketches against exact ranks."""

import numpy as np
import pytest

from assayflow.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    # ties, a heavy group and values of very different size
    return spark.range(0, 60_000, 1, 6).selectExpr(
        "if(id % 3 = 0, 'hot', concat('g', id % 5)) AS feature", "id % 2 AS arm",
        "if(id % 7 = 0, 1.0D, exp(pmod(hash(id), 2000) / 100.0D - 10)) AS level")


def _rank_error(values: np.ndarray, value: float, rank: float) -> float:
    below, upto = (values < value).mean(), (values <= value).mean()
    return max(0.0, below - rank, rank - upto)


@pytest.mark.parametrize("merged", [False, True])
def test_ranks_are_within_the_error(spark, rows, merged):
    parts = sketches.sketch_groups(rows, ["feature", "arm"], "level") if merged else None
    built = sketches.merge_groups(parts, ["feature"]) if merged else sketches.sketch_groups(rows, ["feature"], "level")
    ranks = (0.1, 0.5, 0.9)
    got = built.select("feature", *[sketches.sketched(r).alias(f"r{i}") for i, r in enumerate(ranks)]).collect()
    held = rows.toPandas()
    assert len(got) == 6
    for row in got:
        values = held.loc[held.feature == row.feature, "level"].to_numpy()
        # twice the error of one rank: 36 ranks are looked at
        assert all(_rank_error(values, row[f"r{i}"], r) <= 2 * sketches.RANK_ERROR for i, r in enumerate(ranks))


def test_small_groups_are_exact_and_missing_values_are_skipped(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 9.0), ("a", None), ("a", float("nan")), ("b", None),
                                ("c", float("inf")), (None, 4.0)], "g string, v double")
    got = {r.g: r["median"] for r in sketches.approx_group_median(df, ["g"], "v").collect()}
    assert got == {"a": 5.0, "b": None, "c": float("inf"), None: 4.0}
    assert sketches.approx_group_median(df.limit(0), ["g"], "v").count() == 0
    coarse = sketches.merge_groups(sketches.sketch_groups(df, ["g"], "v"), [])
    assert coarse.select(sketches.sketched(0.5).alias("m")).first()["m"] == 5.0     # 1, 4, 5, 9, inf
