"""Registered queries of the core operators and their SQL counterparts."""

from __future__ import annotations

from lattica.catalog import extract_queries, graph_queries, search_queries, text_queries

MODULES = [graph_queries, text_queries, search_queries, extract_queries]
QUERIES: dict = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL: dict[str, str] = {n: s for m in MODULES for n, s in m.SQL.items()}
