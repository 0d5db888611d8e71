"""Trips from travel-like events, and changes of home base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelore.functions import timebins
from datelore.functions.text import none_if_empty
from datelore.operators.filters import TRAVEL_CATEGORIES, travel_events
from datelore.operators.sequences import stays


def trip_destination() -> Column:
    return F.coalesce(none_if_empty(F.col("location")), F.col("title"))


def trip_timeline(
    df: DataFrame, categories: Sequence[str] = TRAVEL_CATEGORIES, gap_days: float = 3, keys: Sequence[str] = ()
) -> DataFrame:
    """Travel events merged into trips; the event just before must be to the same destination."""
    events = travel_events(df, categories).withColumn("destination", trip_destination())
    return stays(events, keys, "destination", gap_days)


def places_visited(df: DataFrame, categories: Sequence[str] = TRAVEL_CATEGORIES, keys: Sequence[str] = ()) -> DataFrame:
    return trip_timeline(df, categories, keys=keys).groupBy(*keys, "destination").agg(
        F.count("*").alias("trips"),
        F.min("start").alias("first_visit"),
        F.max("end").alias("last_visit"),
        F.sum("duration_days").alias("total_days"),
    )


def trips_by_place(trips: DataFrame, place: str, keys: Sequence[str] = ()) -> DataFrame:
    """Trips and latest end per place, for timelines ordered by recency."""
    return trips.groupBy(*keys, place).agg(F.count("*").alias("trips"), F.max("end").alias("last_end"))


def location_shifts(df: DataFrame, min_share: float = 0.4, keys: Sequence[str] = ()) -> DataFrame:
    """Quarters whose dominant place differs from that of the last clear quarter.

    A quarter is clear when its top place (ties: smallest) holds ``min_share`` of
    its events with a place.
    """
    located = df.filter(F.col("location").isNotNull())
    counted = located.groupBy(*keys, timebins.quarter_start(F.col("start")).alias("quarter"), "location").agg(
        F.count("*").alias("_n")
    )
    tops = counted.groupBy(*keys, "quarter").agg(
        F.min_by("location", F.struct(-F.col("_n"), "location")).alias("location"),
        F.max("_n").alias("visits"),
        F.sum("_n").alias("_all"),
    )
    clear = tops.filter(F.col("visits") / F.col("_all") >= min_share)
    # One row per quarter is left, so the ordered step is short for any calendar.
    before = F.lag("location").over(Window.partitionBy(*keys).orderBy("quarter"))
    moved = clear.withColumn("_before", before).filter(F.col("_before").isNotNull() & (F.col("_before") != F.col("location")))
    return moved.select(*keys, "quarter", "location", "visits")
