"""All queries of the engine by inventory id, with the same computation in ANSI SQL where SQL can say it."""

from __future__ import annotations

from . import q_bars, q_core, q_fair, q_given, q_live, q_sources, q_stats, q_stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in (q_core, q_bars, q_stats, q_fair, q_sources, q_stream, q_live, q_given):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.SQL
