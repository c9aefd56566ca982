"""Registered queries: name -> (function of session and folder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The latest row of each page, in SQL.
PAGES = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC NULLS LAST, indexed_at DESC NULLS LAST, quality_score DESC NULLS LAST) AS rn FROM docs WHERE id IS NOT NULL) WHERE rn = 1)"


def query(sql: str | None = None):
    """Registers a function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def words(items) -> str:
    """A SQL list of strings."""
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def hits(expr: str, items) -> str:
    """How many of the phrases an SQL string holds."""
    return f"len(list_filter({words(items)}, lambda z: contains({expr}, z)))"
