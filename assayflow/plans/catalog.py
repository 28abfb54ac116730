"""Every registered query and its oracle SQL (imports the query modules)."""

from __future__ import annotations

from assayflow.plans import queries, queries_cohort, queries_prep, queries_volcano, queries_whole  # noqa: F401
from assayflow.plans.registry import ORACLE, QUERIES, QueryFn


def queries_map() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_map() -> dict[str, str]:
    return dict(ORACLE)
