"""All registered queries and the SQL that each must equal."""

from __future__ import annotations

from spindrift.plans import metric_queries, placement_queries, source_queries, star_queries, vector_queries  # noqa: F401
from spindrift.plans.declare import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
