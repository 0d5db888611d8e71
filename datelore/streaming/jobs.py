"""Incremental versions of the ingest and of the reports that suit a stream.

A stream carries the row-level columns of the event table (see
``normalize_columns``). Whatever needs counts over the whole calendar, such as
resolving first names, is done when the landed table is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from datelore.functions.text import strip
from datelore.functions.timebins import MICROS_PER_DAY, epoch, instant, micros_between
from datelore.operators.filters import TRAVEL_CATEGORIES, timed_events, travel_events
from datelore.operators.people import exploded_people
from datelore.operators.travel import trip_destination
from datelore.schema import EVENT_COLUMNS, RAW_EVENT, as_utc_ntz
from datelore.sources.events import normalize_columns, resolve_first_names
from datelore.sources.geo import with_coordinates

def stream_events(
    spark: SparkSession, folder: str, keys: Sequence[str] = (), max_files_per_trigger: int | None = None
) -> DataFrame:
    """New JSON-lines files of a folder as normalised rows; ``keys`` are extra text fields of the records."""
    schema = T.StructType([*RAW_EVENT.fields, *[T.StructField(key, T.StringType()) for key in keys]])
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return stream_rows(reader.json(folder), keys)


def stream_rows(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    rows = normalize_columns(raw)
    return rows.withColumn("n_people", F.size("people")).select(*keys, *EVENT_COLUMNS, "startDate", "endDate")


def dedupe_stream(rows: DataFrame, delay: str = "7 days", keys: Sequence[str] = ()) -> DataFrame:
    """Drop copies (same title without case, start and end) that arrive within the delay."""
    marked = rows.withColumn("_title", F.lower(strip(F.coalesce("title", F.lit("")))))
    timed = marked.withColumn("_at", instant(F.col("start"))).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark([*keys, "_title", "startDate", "endDate"]).drop("_title", "_at")


def land_events(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch to its own folder of the table; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/epoch={number}")

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def landed_events(spark: SparkSession, table: str, keys: Sequence[str] = ()) -> DataFrame:
    """The event table over everything landed so far, first names resolved."""
    resolved = resolve_first_names(spark.read.parquet(table), keys)
    return resolved.withColumn("n_people", F.size("people")).select(*keys, *EVENT_COLUMNS)


def weekly_load_stream(rows: DataFrame, delay: str = "7 days", keys: Sequence[str] = ()) -> DataFrame:
    """Hours and events of every week that has closed; weeks run Monday to the Sunday they are named after."""
    # Day 4 of the epoch is a Monday.
    weeks = F.window("_at", "7 days", "7 days", "4 days")
    timed = timed_events(rows).withColumn("_at", instant(F.col("start"))).withWatermark("_at", delay)
    loaded = timed.groupBy(*keys, weeks.alias("_window"))
    summed = loaded.agg(F.sum("duration_hours").alias("total_hours"), F.count("*").alias("event_count"))
    return summed.select(
        *keys, F.date_sub(F.to_date(as_utc_ntz(F.col("_window.end"))), 1).alias("week"), "total_hours", "event_count"
    )


def person_frequency_stream(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running totals per person, for an update-mode sink."""
    return exploded_people(rows).groupBy(*keys, "person").agg(
        F.count("id").alias("events"),
        F.sum("duration_hours").alias("total_hours"),
        F.min("start").alias("first_seen"),
        F.max("start").alias("last_seen"),
    )


def enrich_stream(rows: DataFrame, geo: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Coordinates and labels of each event's place, from the place table as of each micro-batch."""
    geo_keys = [key for key in keys if key in geo.columns]
    return with_coordinates(rows, geo, geo_keys, ("lat", "lon", "city", "country", "place_type"))


_STATE = "place string, start bigint, end bigint, n bigint, places array<string>, starts array<bigint>, ends array<bigint>, ids array<string>"


def trips_stream(
    rows: DataFrame,
    keys: Sequence[str],
    categories: Sequence[str] = TRAVEL_CATEGORIES,
    gap_days: float = 3,
    delay: str = "7 days",
) -> DataFrame:
    """Trips as they close, by the rule of ``trip_timeline``, per calendar.

    Events wait in state until the watermark has passed their start, so they are
    always merged in start order however they arrive. A trip closes when another
    place follows or the gap has passed.
    """
    keys = list(keys)
    gap = int(gap_days * MICROS_PER_DAY)
    events = (
        travel_events(rows, categories)
        .withColumn("_at", instant(F.col("start")))
        .withWatermark("_at", delay)
        .select(
            *keys,
            "_at",
            "id",
            trip_destination().alias("place"),
            micros_between(epoch(), F.col("start")).alias("start_us"),
            micros_between(epoch(), F.col("end")).alias("end_us"),
        )
    )
    types = {field.name: field.dataType.simpleString() for field in events.schema.fields}
    out = ", ".join([f"{key} {types[key]}" for key in keys] + ["destination string, start_us bigint, end_us bigint, n_events bigint"])

    def advance(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        place, start, end, n, places, starts, ends, ids = (
            state.get if state.exists else (None, 0, 0, 0, [], [], [], [])
        )
        waiting = list(zip(starts, ids, ends, places))
        for batch in batches:
            waiting.extend(zip(*[batch[name].tolist() for name in ("start_us", "id", "end_us", "place")]))
        # Events of one moment go by id, as in the batch rule, in whatever order they arrive.
        waiting.sort(key=lambda row: row[:2])
        watermark = state.getCurrentWatermarkMs() * 1000
        closed = []
        done = 0
        for row_start, _, row_end, row_place in waiting:
            if row_start > watermark:
                break
            done += 1
            if n and row_place == place and row_start - end <= gap:
                end, n = max(end, row_end), n + 1
            else:
                if n:
                    closed.append((*key, place, start, end, n))
                place, start, end, n = row_place, row_start, row_end, 1
        waiting = waiting[done:]
        # Nothing that can still arrive or is waiting may join the open trip.
        if n and watermark - end > gap and not (waiting and waiting[0][0] - end <= gap):
            closed.append((*key, place, start, end, n))
            place, start, end, n = None, 0, 0, 0
        if n or waiting:
            state.update((place, start, end, n, *[[w[k] for w in waiting] for k in (3, 0, 2, 1)]))
            # Wake when the open trip can close or the first waiting event is due.
            nearest = min(([end + gap] if n else []) + [w[0] for w in waiting[:1]])
            state.setTimeoutTimestamp(max(nearest // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame(closed, columns=[*keys, "destination", "start_us", "end_us", "n_events"])

    trips = events.groupBy(*keys).applyInPandasWithState(
        advance, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return trips.select(
        *keys,
        "destination",
        F.timestamp_add("MICROSECOND", F.col("start_us"), epoch()).alias("start"),
        F.timestamp_add("MICROSECOND", F.col("end_us"), epoch()).alias("end"),
        "n_events",
        ((F.col("end_us") - F.col("start_us")) / F.lit(float(MICROS_PER_DAY))).alias("duration_days"),
    )
