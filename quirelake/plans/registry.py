"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin where there is one."""

    def add(f):
        @wraps(f)
        def run(spark, folder):
            from quirelake.runtime import ship

            ship(spark)
            return f(spark, folder)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
