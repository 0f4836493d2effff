"""Every registered query of the engine and the SQL it is checked against."""

from __future__ import annotations

from . import benchmark_queries, event_queries, fusion_queries, language_queries, layout_queries, metric_queries, shape_queries, spatial_queries, tier_queries, tree_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "benchmark_queries", "event_queries", "fusion_queries", "language_queries", "layout_queries", "metric_queries", "shape_queries", "spatial_queries", "tier_queries", "tree_queries"]
