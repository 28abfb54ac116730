"""Queries that look at one year or one arm have a whole-table form that holds
the same rows under that key, and rows under every other key."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF001

YEAR, PLACEBO, TREATED = ("time_point", "1996"), ("Treatment", "T01"), ("Treatment", "T03")
FORMS = {
    "ols_categorical_covariate": ("ols_categorical_covariate_all_time_points", *YEAR),
    "ols_numeric_covariate": ("ols_numeric_covariate_all_time_points", *YEAR),
    "ols_multi_covariate": ("ols_multi_covariate_all_time_points", *YEAR),
    "ols_ci": ("ols_ci_all_time_points", *YEAR),
    "fdr_threshold": ("fdr_threshold_all_time_points", *YEAR),
    "feature_class": ("feature_class_all_time_points", *YEAR),
    "bh_adjust": ("bh_adjust_all_arms", *PLACEBO),
    "significant_count": ("significant_count_all_arms", *PLACEBO),
    "pivot_visit_zero_fill": ("pivot_visit_zero_fill_all_arms", *TREATED),
    "fold_change_visits": ("fold_change_visits_all_arms", *TREATED),
    "stats_fc_outer": ("stats_fc_outer_all_arms", *TREATED),
}


def _rows(rows, columns):
    norm = lambda x: round(x, 5) if isinstance(x, float) else x
    return sorted((tuple(norm(r[c]) for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(FORMS))
def test_whole_table_form_holds_the_narrow_one(spark, name):
    whole, key, value = FORMS[name]
    assert whole in entry.oracle_sql()
    narrow = entry.queries()[name](spark, SF001)
    rows = entry.queries()[whole](spark, SF001).collect()
    assert len({str(r[key]) for r in rows}) > 1
    assert _rows((r for r in rows if str(r[key]) == value), narrow.columns) == _rows(narrow.collect(), narrow.columns)
