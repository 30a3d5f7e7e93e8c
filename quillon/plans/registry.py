"""Registration of queries with their oracle statements."""

from __future__ import annotations

from collections.abc import Callable


def collector() -> tuple[dict, dict[str, str], Callable]:
    """(queries, oracles, decorator): the decorator files a function under its name."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return keep

    return queries, oracles, query
