"""JSON sink for report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso_text(moment: Column) -> Column:
    """ISO text with "Z"; fractions of a second, when there are any, have six digits."""
    text = F.replace(moment.cast("string"), F.lit(" "), F.lit("T"))
    exact = F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)
    return F.concat(exact, F.lit("Z"))


def to_records(df: DataFrame) -> DataFrame:
    """Report columns in their exported form: UTC times as ISO text with "Z", NaN as null."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            column = iso_text(column if isinstance(field.dataType, T.TimestampType) else column.cast("timestamp_ntz"))
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.when(~F.isnan(column), column)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    to_records(df).write.mode(mode).option("ignoreNullFields", False).json(path)
