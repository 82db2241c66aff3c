"""Registered queries."""

from . import audit_queries, evaluation_queries, feature_queries, model_queries, panel_queries, scored_queries, source_queries  # noqa: F401  (they register their queries)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
