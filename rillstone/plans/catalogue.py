"""Catalogue of named queries with their oracle SQL."""

from __future__ import annotations

from rillstone.plans import clean_queries, feature_queries, lake_queries  # noqa: F401  they register themselves
from rillstone.plans.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
