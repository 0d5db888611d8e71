"""Duplicate removal that keeps a chosen copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelore.functions.text import strip
from datelore.schema import parse_utc


def keep_first(df: DataFrame, partition: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each partition in the given order.

    A rank filter lets every task drop all but its own first row before the
    shuffle, so a group that holds much of the data never meets in one task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def dedupe_events(
    raw: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("priority", "id"), by_instant: bool = False
) -> DataFrame:
    """One record per (title, start, end); titles compare trimmed and without case.

    Times compare as written. ``by_instant`` compares the moments instead, so
    that two spellings of one time match.
    """
    title = F.lower(strip(F.coalesce("title", F.lit(""))))
    start, end = F.col("startDate"), F.col("endDate")
    if by_instant:
        start, end = parse_utc(start), parse_utc(end)
    return keep_first(raw, [*keys, title, start, end], order)


def dedupe_occurrences(events: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("end", "title")) -> DataFrame:
    """One row per (id, start); repeats of a series keep their own rows."""
    return keep_first(events, [*keys, "id", "start"], order)
