"""Row filters shared by every report. All are plain predicates that reach the scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.functions.text import strip
from datelore.functions.timebins import naive

# --- Fixed values ---
TRAVEL_CATEGORIES = ["travel", "flight", "trip", "vacation", "vacay", "holiday"]
TRAVEL_TITLE = r"(?iU)\b(?:flight|trip to|traveling to|travelling to|vacation|vacay)\b"
DATE_CATEGORIES = ["date", "first date"]
COMPLETE_ADDRESS = r"(?iU)\b\d{5}(-\d{4})?\b|\bunited states\b|\busa\b|\bcanada\b"
# --- end of fixed values ---


def timed_events(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_all_day"))


def in_date_range(df: DataFrame, start_date: dt.date | None = None, end_date: dt.date | None = None) -> DataFrame:
    """Both dates inclusive."""
    if start_date is not None:
        df = df.filter(F.col("start") >= naive(start_date))
    if end_date is not None:
        df = df.filter(F.col("start") < naive(end_date + dt.timedelta(days=1)))
    return df


def exclude_categories(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Drop categories regardless of case; events without a category stay."""
    names = sorted({name.lower() for name in categories if name})
    if not names:
        return df
    return df.filter(~F.coalesce(F.lower("category").isin(names), F.lit(False)))


def global_filters(df: DataFrame, start_date=None, end_date=None, excluded: Sequence[str] = ()) -> DataFrame:
    """The filters every report of the dashboard sends."""
    return exclude_categories(in_date_range(df, start_date, end_date), excluded)


def category_in(categories: Sequence[str]) -> Column:
    return F.coalesce(F.lower("category").isin(sorted({c.lower() for c in categories})), F.lit(False))


def in_category(df: DataFrame, category: str | None) -> DataFrame:
    return df if category is None else df.filter(category_in([category]))


def not_in_category(df: DataFrame, category: str | None) -> DataFrame:
    return df if category is None else df.filter(~category_in([category]))


def with_person(df: DataFrame, person: str | None) -> DataFrame:
    return df if person is None else df.filter(F.array_contains("people", person))


def in_years(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    if first is not None:
        df = df.filter(F.col("year") >= first)
    return df if last is None else df.filter(F.col("year") <= last)


def located_events(df: DataFrame) -> DataFrame:
    """Rows whose place is more than white space."""
    return df.filter(F.col("location").isNotNull() & (strip(F.col("location")) != ""))


def travel_events(df: DataFrame, categories: Sequence[str] = TRAVEL_CATEGORIES) -> DataFrame:
    return df.filter(category_in(categories) | F.coalesce("title", F.lit("")).rlike(TRAVEL_TITLE))


def date_events(df: DataFrame, categories: Sequence[str] = DATE_CATEGORIES) -> DataFrame:
    """Date-like events with the first of their sorted guests as partner."""
    return df.filter(category_in(categories)).withColumn("date_partner", F.get("people", F.lit(0)))


def upcoming_events(df: DataFrame, as_of: Column, days_ahead: int = 14) -> DataFrame:
    """Timed events with a place that start after ``as_of`` and within the window."""
    until = as_of + F.make_dt_interval(days=F.lit(days_ahead))
    return timed_events(df).filter(
        (F.col("start") > as_of) & (F.col("start") <= until) & F.col("location").isNotNull()
    )


def history(df: DataFrame, as_of: Column) -> DataFrame:
    return df.filter(F.col("start") <= as_of)


def is_complete_address(location: Column) -> Column:
    return location.rlike(COMPLETE_ADDRESS)
