"""All registered queries of the engine, and their SQL."""

from __future__ import annotations

from arborlake.plans import queries_analysis, queries_encode, queries_sampling, queries_splits, queries_trees
from arborlake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "queries_analysis", "queries_encode", "queries_sampling", "queries_splits", "queries_trees"]
