"""Imports every module that registers queries."""

from __future__ import annotations

from . import label_queries, metric_queries, process_queries, relational_queries, retrieval_queries, text_queries, textgen_queries  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = "f3_rank_fusion"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
