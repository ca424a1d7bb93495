"""Composed plans and the registry of named queries."""

from codexspark.plans import container_queries, markup_queries, scalar_queries  # noqa: F401
from codexspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
