"""Bulk ingest of iCalendar files.

Files are read as text records that end at each ``BEGIN:VEVENT``, so a file of
any size splits across tasks and no task ever holds a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datelore.functions import text
from datelore.operators.common import reading_all
from datelore.schema import RAW_EVENT
from datelore.sources import zones
from datelore.sources.records import iso_text
from datelore.sources.zones import property_of as _property


def unescape(value: Column) -> Column:
    """Undo text escapes; a doubled backslash is set aside so that it is read once."""
    value = F.replace(value, F.lit("\\\\"), F.lit("\x00"))
    value = F.regexp_replace(value, r"\\[nN]", "\n")
    value = F.regexp_replace(value, r"\\([,;])", "$1")
    return F.replace(value, F.lit("\x00"), F.lit("\\"))


def iso_utc(params: Column, value: Column, own_zones: Column) -> Column:
    """DTSTART/DTEND value to "yyyy-MM-ddTHH:mm:ssZ".

    A time with a TZID is converted to UTC by its IANA or Windows zone or by the file's own rules
    (see ``zones``); a floating time, or one of a zone that none of them names, is kept, and a plain
    date becomes midnight.
    """
    wall = zones.wall_time(value)
    zone = text.none_if_empty(F.trim(F.regexp_extract(params, r'(?i);TZID="?([^";:]+)"?', 1)))
    moment = F.when(~value.endswith("Z") & zone.isNotNull(), zones.to_utc(wall, zone, own_zones)).otherwise(wall)
    date = F.regexp_replace(value, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    day = F.when(value.rlike(r"^\d{8}$"), date.try_cast("timestamp_ntz"))
    return iso_text(F.coalesce(moment, day))


def _attendees(block: Column) -> Column:
    lines = F.regexp_extract_all(block, F.lit(r"(?im)^(ATTENDEE(?:;.*)?:.*?)\r?$"), F.lit(1))

    def name(line: Column) -> Column:
        common = F.regexp_extract(line, r'(?i);CN=(?:"([^"]*)"|([^;:]*))', 0)
        common = F.regexp_replace(common, r'(?i)^;CN=|"', "")
        address = F.regexp_extract(line, r'^ATTENDEE(?:;(?:"[^"]*"|[^":])*)?:(.*)$', 1)
        return text.attendee_name(common, address)

    return F.transform(lines, name)


def raw_records(reader, path) -> DataFrame:
    """Text records ``(value, file, block)`` that end at each event's begin, from a batch or a stream reader."""
    metadata = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return reader.option("lineSep", "BEGIN:VEVENT").text(path).select("value", *metadata)


def read_ics(spark: SparkSession, path, source_id: str, default_title: str) -> DataFrame:
    """One raw record per VEVENT with a start; also ``source_id``."""
    return parse_ics(raw_records(spark.read, path), F.lit(source_id), F.lit(default_title)).select(*RAW_EVENT.fieldNames(), "source_id")


def parse_ics(raw: DataFrame, source_id: Column, default_title: Column) -> DataFrame:
    """Events of ``raw_records`` in file order; ``source_id`` and ``default_title`` may depend on ``file``. Also gives ``file``.

    What holds for a whole file (its name, its source, its time zones and the years its events lie in) and where the events of
    each of its blocks begin to count is summed up in one row for each block, which meets the events again. So the text is
    read twice, and only once for the events.
    """
    # Asked of all uses alike, so that Spark adds no such filter to one of them and sums up blocks twice.
    placed = raw.filter("file is not null and block is not null")
    records = placed.select("file", "block", F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", r"\r?\n[ \t]", "").alias("body"))
    header = r"(?im)^X-WR-CALNAME(?:;[^:\r\n]*)?:(.*?)\r?$"
    body = F.col("body")
    is_event = body.rlike(r"(?im)^END:VEVENT")
    zone_blocks = F.regexp_extract_all(body, F.lit(zones.ZONE_BLOCK), F.lit(0))
    years = F.transform(F.regexp_extract_all(body, F.lit(r"(?im)^DT(?:START|END)(?:;[^:\r\n]*)?:(\d{4})"), F.lit(1)), lambda y: y.cast("int"))
    told = records.select("file", "block", "seq", "body", zone_blocks.alias("found"), F.when(is_event, years).alias("years"), body.rlike(header).alias("named"))
    blocks = told.groupBy("file", "block").agg(
        F.min_by(F.when(F.col("named"), unescape(F.regexp_extract(body, header, 1))), F.when(F.col("named"), F.col("seq"))).alias("calendar_name"),
        F.flatten(F.collect_list(F.when(F.size("found") > 0, F.col("found")))).alias("zone_blocks"),
        F.min(F.array_min("years")).alias("first_year"),
        F.max(F.array_max("years")).alias("last_year"),
        F.max("named").alias("named"),
        # The first block's leading record is the file header, not an event; only events are counted.
        F.min(F.when(F.col("years").isNotNull(), F.col("seq"))).alias("first_seq"),
        F.count("years").alias("n"),
    )
    blocks = reading_all(blocks)
    files = blocks.groupBy("file").agg(
        F.min_by("calendar_name", F.when(F.col("named"), F.col("block"))).alias("calendar_name"),
        F.flatten(F.collect_list("zone_blocks")).alias("zone_blocks"),
        F.min("first_year").alias("first_year"),
        F.max("last_year").alias("last_year"),
    )
    own = zones.zone_table(files.select("file", F.explode("zone_blocks").alias("zone_block"), "first_year", "last_year"))
    title = F.coalesce(text.none_if_empty(F.col("calendar_name")), default_title)
    known = files.select("file", title.alias("calendarTitle"), source_id.alias("source_id")).join(own, "file", "left")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.filter("n > 0").select("file", "block", "first_seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    events = records.filter(is_event).withColumn(
        "body", F.regexp_replace(F.regexp_replace("body", r"(?is)END:VEVENT.*\z", ""), r"(?is)BEGIN:VALARM.*?END:VALARM", "")
    )
    titled = events.join(starts.join(known, "file"), ["file", "block"])
    # Each property is looked for once.
    names = {"summary": "SUMMARY", "place": "LOCATION", "start": "DTSTART", "end": "DTEND", "uid": "UID", "link": "URL", "rule": "RRULE"}
    titled = titled.select(
        "file", "block", "seq", "first_seq", "offset", "zones", "source_id", "calendarTitle",
        *[_property(body, name).alias(f"_{column}") for column, name in names.items()],
        *[_property(body, names[column], 1).alias(f"_{column}_params") for column in ("start", "end")],
        text.none_if_empty(unescape(_property(body, "DESCRIPTION"))).alias("notes"),
        _attendees(body).alias("attendees"),
    ).filter(F.col("_start").isNotNull())
    start = iso_utc(F.col("_start_params"), F.col("_start"), F.col("zones"))
    end = iso_utc(F.col("_end_params"), F.col("_end"), F.col("zones"))
    # An event without a UID is numbered by its position in the file. Records of one block are consecutive in their partition, so
    # that is the events of earlier blocks plus the distance to its block's first event.
    position = (F.col("offset") + F.col("seq") - F.col("first_seq")).cast("string")
    timed = titled.withColumns({"startDate": start, "endDate": end, "_own": text.none_if_empty(F.col("_uid"))})
    return timed.select(
        "file",
        "block",
        "seq",
        F.col("_own").alias("uid"),
        F.coalesce(unescape(F.col("_summary")), F.lit("")).alias("title"),
        "notes",
        text.none_if_empty(unescape(F.col("_place"))).alias("location"),
        "startDate",
        F.coalesce("endDate", "startDate").alias("endDate"),
        F.col("_start").rlike(r"^\d{8}$").alias("isAllDay"),
        "calendarTitle",
        F.lit(None).cast("string").alias("calendarColorHex"),
        "attendees",
        F.col("_rule").isNotNull().alias("isRecurring"),
        text.none_if_empty(F.col("_link")).alias("url"),
        text.parse_note_tags(F.col("notes")).alias("noteTags"),
        F.concat_ws(":", "source_id", F.coalesce("_own", F.concat_ws("-", "source_id", position))).alias("id"),
        "source_id",
    )
