"""All registered queries and the SQL that each must equal. Keys are operator numbers of the survey with a word."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir)."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put
