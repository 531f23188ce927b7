"""Names, queries and their SQL counterparts."""

from __future__ import annotations

from .plans import asset_queries, code_queries, file_queries, graph_queries, language_queries, registry

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES

__all__ = ["ORACLES", "QUERIES", "asset_queries", "code_queries", "file_queries", "graph_queries", "language_queries"]
