"""All registered queries of the library."""

from __future__ import annotations

from gridmark.plans import check_queries, clip_queries, cv_queries, expression_queries, match_queries, model_queries, pitch_queries, report_queries, score_queries, table_queries, time_queries  # noqa: F401  importing a module registers its queries
from gridmark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
