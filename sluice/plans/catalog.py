"""The queries over the test tables, by name, each with its SQL."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: a callable (spark, sf_dir) -> DataFrame under ``name``, and its SQL where there is one."""

    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    from . import graph_queries, source_queries, stream_queries  # noqa: F401  they register

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
