"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from tarnwick.llm import oracles, queries_corpus, queries_models, queries_native, queries_packing, queries_repeats, queries_vectors

_MODULES = [queries_native, queries_models, queries_corpus, queries_packing, queries_vectors, queries_repeats]

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
ORACLE_SQL |= oracles.ORACLE_SQL
