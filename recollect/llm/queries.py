"""The registered queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from recollect.llm import query_chat, query_embeddings, query_lines, query_minhash, query_mixing, query_negatives, query_packing, query_passages, query_quality, query_sharding, query_spelling, query_tokens, query_urls

_MODULES = (query_tokens, query_minhash, query_embeddings, query_urls, query_mixing, query_lines, query_chat, query_quality, query_packing, query_sharding, query_negatives, query_passages, query_spelling)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
