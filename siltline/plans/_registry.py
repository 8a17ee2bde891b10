"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries of one module and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable:
        """Register a query under its function's name, with the SQL that gives the same rows."""

        def add(f: Callable) -> Callable:
            self.queries[name or f.__name__] = f
            if sql:
                self.oracle[name or f.__name__] = sql
            return f

        return add
