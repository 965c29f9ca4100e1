"""All queries over the driver's tables and their SQL."""

from __future__ import annotations

from tarnwick.plans import queries_audit, queries_basic, queries_curves, queries_more

_MODULES = [queries_basic, queries_audit, queries_curves, queries_more]

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
