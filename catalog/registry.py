"""Registration of queries with their oracle SQL."""

from __future__ import annotations


def registry():
    queries: dict = {}
    oracle: dict = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql is not None:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
