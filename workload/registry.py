"""Named queries over the sample tables, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Types every engine prints alike: rounded doubles, text times, joined lists, wide integers."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            column = F.round(column, 6) + F.lit(0.0)
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            text = column.cast("string")
            column = F.rpad(F.when(F.contains(text, F.lit(".")), text).otherwise(F.concat(text, F.lit("."))), 26, "0")
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column, "|")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` together with its SQL, when SQL can express it."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return portable(build(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
