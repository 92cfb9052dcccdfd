"""All queries of the library by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.plans import align_queries, graph_queries, qa_queries, search_queries, text_queries

_ALL = graph_queries.QUERIES | search_queries.QUERIES | text_queries.QUERIES | align_queries.QUERIES | qa_queries.QUERIES

QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
