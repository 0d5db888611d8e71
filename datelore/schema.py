"""Schemas of the tables the jobs exchange."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())

# One exported calendar record, before normalisation.
RAW_EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("startDate", T.StringType()),
        T.StructField("endDate", T.StringType()),
        T.StructField("isAllDay", T.BooleanType()),
        T.StructField("calendarTitle", T.StringType()),
        T.StructField("calendarColorHex", T.StringType()),
        T.StructField("attendees", _STRINGS),
        T.StructField("isRecurring", T.BooleanType()),
        T.StructField("url", T.StringType()),
        T.StructField("noteTags", T.MapType(T.StringType(), _STRINGS)),
    ]
)

# The normalised event table every report reads.
EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("start", T.TimestampNTZType()),
        T.StructField("end", T.TimestampNTZType()),
        T.StructField("duration_hours", T.DoubleType()),
        T.StructField("is_all_day", T.BooleanType()),
        T.StructField("calendar", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("calendar_color", T.StringType()),
        T.StructField("people", _STRINGS),
        T.StructField("n_people", T.IntegerType()),
        T.StructField("is_recurring", T.BooleanType()),
        T.StructField("url", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("week", T.IntegerType()),
        T.StructField("weekday", T.StringType()),
        T.StructField("season", T.StringType()),
    ]
)
EVENT_COLUMNS = EVENT.fieldNames()

GEO_FIELDS = T.StructType(
    [
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("neighbourhood", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("place_type", T.StringType()),
    ]
)
GEO_COLUMNS = GEO_FIELDS.fieldNames()
GEO = T.StructType([T.StructField("location", T.StringType()), *GEO_FIELDS.fields])

SOURCE = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("visible", T.BooleanType()),
        T.StructField("added_at", T.TimestampNTZType()),
        T.StructField("last_synced", T.TimestampNTZType()),
        T.StructField("last_sync_error", T.StringType()),
        T.StructField("event_count", T.LongType()),
    ]
)


def as_utc_ntz(instant: Column) -> Column:
    """UTC wall-clock time of an instant, whatever the session time zone is."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit("1970-01-01").cast("timestamp_ntz"))


def parse_utc(text: Column) -> Column:
    """ISO-8601 text to naive UTC; an explicit offset is honoured, no offset means UTC.

    Text that is no timestamp becomes null instead of failing the job.
    """
    has_offset = text.rlike(r"[Tt ].*[+-]\d{2}:?\d{2}\s*$")
    return F.when(has_offset, as_utc_ntz(text.try_cast("timestamp"))).otherwise(text.try_cast("timestamp_ntz"))
