"""Every query of the volume engine by name, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame under the id of its operator."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep
