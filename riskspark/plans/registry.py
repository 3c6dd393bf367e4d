"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL where SQL can express it."""

    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return register


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, widen integers and show times as microseconds, for engine-independent values."""

    def plain(field: T.StructField) -> str:
        name = f"`{field.name}`"
        if isinstance(field.dataType, T.DoubleType):
            # Adding zero turns -0.0 into 0.0.
            return f"round({name}, {digits}) + 0D AS {name}"
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            return f"CAST({name} AS bigint) AS {name}"
        if isinstance(field.dataType, T.TimestampType):
            return f"unix_micros({name}) AS {name}"
        return name

    return df.selectExpr(*[plain(field) for field in df.schema.fields])
