"""Importing this module registers every query."""

from telesift.plans import base_queries, cluster_queries, model_queries, report_queries, stat_queries, view_queries  # noqa: F401
from telesift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
