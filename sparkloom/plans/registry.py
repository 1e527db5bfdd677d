"""Where queries and their DuckDB counterparts are entered."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def enter(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return enter
