"""How a plan module registers its queries."""

from __future__ import annotations


class Plans:
    """Queries of one module by name, and the SQL that says the same."""

    def __init__(self):
        self.QUERIES, self.SQL = {}, {}

    def query(self, sql: str | None = None, name: str | None = None):
        def add(f):
            key = name or f.__name__
            self.QUERIES[key] = f
            if sql:
                self.SQL[key] = sql
            return f

        return add
