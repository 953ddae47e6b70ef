"""A decorator that files a query under its name, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable


def register(queries: dict, oracles: dict) -> Callable:
    def query(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return query
