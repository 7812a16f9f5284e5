"""Every query of the engine by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from . import engine_queries, event_queries, graph_queries, lint_queries, rank_queries, session_queries, source_queries, stream_queries, text_queries

_MODULES = (text_queries, lint_queries, event_queries, graph_queries, rank_queries, session_queries, engine_queries, source_queries, stream_queries)


def queries() -> dict[str, Callable]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
