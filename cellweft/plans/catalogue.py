"""All queries of the library, by name."""

from __future__ import annotations

from cellweft.plans import graph_queries, normalize_queries, platform_queries, relational_queries, spatial_queries  # noqa: F401  they register themselves
from cellweft.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
