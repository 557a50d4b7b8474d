"""The query registry: one entry per operator, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator id and, where it has one, its SQL twin."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def r(column: str | Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero, named like its column."""
    col = F.col(column) if isinstance(column, str) else column
    out = F.round(col.cast("double"), digits) + F.lit(0.0)
    return out.alias(column) if isinstance(column, str) else out


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round the named columns in place."""
    return df.withColumns({c: r(F.col(c), digits) for c in columns})


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`r`."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
