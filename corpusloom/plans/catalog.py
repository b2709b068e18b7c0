"""Loads every module that registers queries."""

from __future__ import annotations

import importlib

from corpusloom.plans.registry import ORACLES, QUERIES

MODULES = [
    "text_queries",
    "model_queries",
    "stats_queries",
    "pair_queries",
    "vector_queries",
    "graph_queries",
    "sequence_queries",
    "source_queries",
    "api_queries",
]
for _m in MODULES:
    importlib.import_module(f"corpusloom.plans.{_m}")

__all__ = ["ORACLES", "QUERIES"]
