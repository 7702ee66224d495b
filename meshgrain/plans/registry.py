"""The named queries, and for those that SQL can express, DuckDB SQL that gives the same rows."""

from __future__ import annotations

from functools import wraps

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return wraps(f)(f)

    return register
