"""The queries by name, and the SQL that says the same, as the catalogue's modules add them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"{name} is there already")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(c: str | Column, digits: int) -> Column:
    """Rounds the scaled value, as the SQL does: sums that end in half a digit may be off by their last bit, which scaling heals."""
    scale = F.lit(10.0**digits)
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") * scale) / scale


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)
