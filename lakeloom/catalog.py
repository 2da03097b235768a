"""Registered queries of the core library and their DuckDB statements."""

from __future__ import annotations

from lakeloom.plans import answer_queries, edit_queries, evidence_queries, graph_queries, knowledge_queries, memory_mode_queries, memory_queries, mode_queries, search_queries, source_queries, store_queries, text_queries, upkeep_queries  # noqa: F401
from lakeloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
