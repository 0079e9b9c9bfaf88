"""Queries over the reference tables; importing this package registers them."""

from . import catalogue_queries, enrich_queries, learn_queries, matrix_queries, rule_queries, source_queries, stats_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
