"""Collects every query module into one registry."""

from tidemark.plans import basic_queries, data_queries, fund_queries, market_queries, text_queries  # noqa: F401
from tidemark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
