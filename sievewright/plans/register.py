"""A register of queries with their SQL."""

from __future__ import annotations


class Register:
    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        def keep(f):
            self.queries[name or f.__name__] = f
            if sql:
                self.oracle[name or f.__name__] = sql
            return f

        return keep
