"""Registry of queries and of the equivalent SQL used to check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query; without ``sql`` it is checked by row count and unit tests only."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rnd(col: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0.0 turns -0.0 into 0.0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def r(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floats, widen integers and turn flags into numbers, so both engines hash alike."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = rnd(c, digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType, T.BooleanType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
