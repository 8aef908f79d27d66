"""Registration of queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def r4(c: Column | str) -> Column:
    """Four digits, away from ties, so that engines that sum in another order agree."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 4)


def q4(x: str) -> str:
    """``r4`` in SQL."""
    return f"round({x} + 1e-9, 4)"
