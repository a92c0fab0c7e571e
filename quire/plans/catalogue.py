"""All queries over the reference tables, by name, with their SQL."""

from __future__ import annotations

from quire.plans import join_queries, latex_queries, report_queries, sequence_queries, status_queries, structure_queries, text_queries  # noqa: F401
from quire.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
