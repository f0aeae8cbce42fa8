"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _widen(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so both sides of a comparison have one integer type."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(*[
        F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, small)
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` gives the same rows on the same tables."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf: _widen(fn(spark, sf))
        if sql:
            ORACLES[name] = sql
        return fn

    return add
