"""All registered queries and their SQL."""

from __future__ import annotations

from recollect.plans import fold_queries, graph_queries, input_queries, integration_queries, memory_queries, score_queries, search_queries, stored_queries, stream_queries, text_queries, time_queries

_MODULES = (text_queries, score_queries, time_queries, fold_queries, graph_queries, search_queries, stream_queries, memory_queries, stored_queries, integration_queries, input_queries)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
