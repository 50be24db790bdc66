"""Registered queries: the operators over derived package tables, with their checks."""

from . import graph_queries, planning_queries, resolution_queries, source_queries, sync_queries, version_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graph_queries", "planning_queries", "resolution_queries", "source_queries", "sync_queries", "version_queries"]
