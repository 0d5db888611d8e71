"""Read exported calendar records and normalise them into the event table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.functions import text, timebins
from datelore.operators.common import reading_all
from datelore.schema import EVENT_COLUMNS, RAW_EVENT, parse_utc

LAYOUTS = ("lines", "array", "parquet")
#: Events without a guest list to look up are dealt to this many groups.
SPREAD = 1024


def read_events(spark: SparkSession, path, layout: str = "lines") -> DataFrame:
    """Raw records from JSON files (one record per line, or one array per file) or parquet.

    ``lines`` and ``parquet`` split inside a file; an ``array`` file is parsed by
    one task, so large exports should land as one of the other two.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}, got {layout!r}")
    if layout == "parquet":
        return with_raw_columns(spark.read.parquet(path))
    return spark.read.schema(RAW_EVENT).option("multiLine", layout == "array").json(path)


def with_raw_columns(raw: DataFrame) -> DataFrame:
    """Add the record columns an older export lacks, as nulls of the right type."""
    missing = [field for field in RAW_EVENT.fields if field.name not in raw.columns]
    return raw.withColumns({field.name: F.lit(None).cast(field.dataType) for field in missing})


def read_uploaded_events(spark: SparkSession, path, source_id: str, layout: str = "lines") -> DataFrame:
    """Records of an uploaded export; ids carry the source id so they cannot collide."""
    return namespace_ids(read_events(spark, path, layout), source_id)


def namespace_ids(raw: DataFrame, source_id: str) -> DataFrame:
    return raw.withColumns({"id": F.concat_ws(":", F.lit(source_id), "id"), "source_id": F.lit(source_id)})


def guest_lists(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct guest lists and how many events have them: (keys, people, n)."""
    return events.groupBy(*keys, "people").agg(F.count("*").alias("n"))


def full_name_by_first_name(lists: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent "First Rest" form of each first name over counted guest lists; ties go to the smaller name."""
    names = lists.select(*keys, "n", F.explode("people").alias("name")).filter(F.col("name").contains(" "))
    counted = names.groupBy(*keys, F.substring_index("name", " ", 1).alias("first_name"), "name").agg(
        F.sum("n").alias("n")
    )
    # A name that ends right after its blank has no last name to offer.
    counted = counted.filter(F.expr("length(name) > length(first_name) + 1"))
    return counted.groupBy(*keys, "first_name").agg(
        F.min_by("name", F.struct(-F.col("n"), "name")).alias("full_name")
    )


def resolve_first_names(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rewrite bare first names of group events to the full form used elsewhere.

    Names are counted and looked up on the distinct guest lists, so that work
    follows the number of lists, not of events.
    """
    keys = list(keys)
    lists = guest_lists(events, keys)
    bare = F.filter("people", lambda name: ~name.contains(" "))
    # Counts are at least 1. As a factor they keep the tests above the aggregate, whose
    # shuffled result then serves both the name counts and the lookups.
    once = F.least("n", F.lit(1))
    groups = reading_all(lists).filter((F.size("people") * once > 1) & (F.size(bare) * once > 0))
    members = groups.select(*keys, "people", F.explode("people").alias("first_name"))
    resolved = (
        members.join(full_name_by_first_name(lists, keys), [*keys, "first_name"], "left")
        .groupBy(*keys, "people")
        .agg(F.sort_array(F.collect_set(F.coalesce("full_name", "first_name"))).alias("_resolved"))
    )
    # Most events have no guests or full names only; they have no key to look up and are spread over all tasks.
    bare_guest = F.exists("people", lambda name: ~name.contains(" "))
    looked_up = (F.size("people") > 1) & bare_guest
    placed = events.withColumns(
        {
            "_list": F.when(looked_up, F.col("people")),
            "_spread": F.when(looked_up, F.lit(0)).otherwise(F.pmod(F.hash("id"), F.lit(SPREAD)) + 1),
        }
    )
    joined = placed.join(resolved.withColumnRenamed("people", "_list").withColumn("_spread", F.lit(0)), [*keys, "_list", "_spread"], "left")
    return joined.withColumn("people", F.coalesce("_resolved", "people")).drop("_resolved", "_list", "_spread")


def normalize_columns(raw: DataFrame) -> DataFrame:
    """Every normalised column that depends on its own row only."""
    tags = F.col("noteTags")
    place = F.coalesce(text.first_tag(tags, "location"), F.col("location"))
    nobody = F.array().cast("array<string>")
    people = F.sort_array(
        F.array_distinct(
            F.filter(
                F.concat(
                    F.coalesce("attendees", nobody),
                    text.tag_values(tags, "people"),
                    text.tag_values(tags, "with"),
                    text.people_from_title(F.col("title")),
                ),
                lambda name: name.isNotNull(),
            )
        )
    )
    typed = with_raw_columns(raw).withColumns(
        {
            "start": parse_utc(F.col("startDate")),
            "end": parse_utc(F.col("endDate")),
            "is_all_day": F.coalesce("isAllDay", F.lit(False)),
            "calendar": F.col("calendarTitle"),
            "category": F.coalesce(text.first_tag(tags, "category"), F.col("calendarTitle")),
            "location": F.when(text.is_junk_location(place), F.lit(None)).otherwise(place),
            "calendar_color": F.col("calendarColorHex"),
            "people": people,
            "is_recurring": F.col("isRecurring"),
        }
    )
    return typed.withColumns(
        {
            "duration_hours": timebins.hours_between(F.col("start"), F.col("end")),
            "year": F.year("start"),
            "month": F.month("start"),
            "week": F.weekofyear("start"),
            "weekday": timebins.weekday_name(F.col("start")),
            "season": timebins.season(F.month("start")),
        }
    )


def normalize_events(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Raw records to the event table; ``keys`` columns are kept in front."""
    resolved = resolve_first_names(normalize_columns(raw), keys)
    return resolved.withColumn("n_people", F.size("people")).select(*keys, *EVENT_COLUMNS)


def export_filter(
    events: DataFrame, calendars: Sequence[str] | None, start: dt.datetime, end: dt.datetime
) -> DataFrame:
    """Events of the named calendars that start inside [start, end)."""
    chosen = events.filter((F.col("start") >= timebins.naive(start)) & (F.col("start") < timebins.naive(end)))
    return chosen if calendars is None else chosen.filter(F.col("calendar").isin(list(calendars)))
