"""Importing this module registers every named query."""

from tidemark.plans import cohort_queries, metric_queries, rolling_queries, snapshot_queries, screening_queries, source_queries, spine_queries, tier_queries, unified_queries  # noqa: F401
from tidemark.plans.registry import QUERIES  # noqa: F401
