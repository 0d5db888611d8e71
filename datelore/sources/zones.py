"""Time zones of iCalendar files: IANA names, Windows names, and rules that a file brings along.

A file's own ``VTIMEZONE`` rules become a table of transitions, as wall time and new offset. A local
time finds its offset as of the last transition before it.
"""

from __future__ import annotations

import zoneinfo
from functools import cache
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Windows zone names and the IANA zone each stands for where no territory is given.
WINDOWS = {
    "AUS Central Standard Time": "Australia/Darwin",
    "AUS Eastern Standard Time": "Australia/Sydney",
    "Afghanistan Standard Time": "Asia/Kabul",
    "Alaskan Standard Time": "America/Anchorage",
    "Aleutian Standard Time": "America/Adak",
    "Arab Standard Time": "Asia/Riyadh",
    "Arabian Standard Time": "Asia/Dubai",
    "Arabic Standard Time": "Asia/Baghdad",
    "Argentina Standard Time": "America/Argentina/Buenos_Aires",
    "Atlantic Standard Time": "America/Halifax",
    "Azerbaijan Standard Time": "Asia/Baku",
    "Azores Standard Time": "Atlantic/Azores",
    "Bahia Standard Time": "America/Bahia",
    "Bangladesh Standard Time": "Asia/Dhaka",
    "Belarus Standard Time": "Europe/Minsk",
    "Canada Central Standard Time": "America/Regina",
    "Cape Verde Standard Time": "Atlantic/Cape_Verde",
    "Caucasus Standard Time": "Asia/Yerevan",
    "Cen. Australia Standard Time": "Australia/Adelaide",
    "Central America Standard Time": "America/Guatemala",
    "Central Asia Standard Time": "Asia/Almaty",
    "Central Brazilian Standard Time": "America/Cuiaba",
    "Central Europe Standard Time": "Europe/Budapest",
    "Central European Standard Time": "Europe/Warsaw",
    "Central Pacific Standard Time": "Pacific/Guadalcanal",
    "Central Standard Time": "America/Chicago",
    "Central Standard Time (Mexico)": "America/Mexico_City",
    "China Standard Time": "Asia/Shanghai",
    "Cuba Standard Time": "America/Havana",
    "E. Africa Standard Time": "Africa/Nairobi",
    "E. Australia Standard Time": "Australia/Brisbane",
    "E. Europe Standard Time": "Europe/Chisinau",
    "E. South America Standard Time": "America/Sao_Paulo",
    "Eastern Standard Time": "America/New_York",
    "Eastern Standard Time (Mexico)": "America/Cancun",
    "Egypt Standard Time": "Africa/Cairo",
    "FLE Standard Time": "Europe/Kiev",
    "Fiji Standard Time": "Pacific/Fiji",
    "GMT Standard Time": "Europe/London",
    "GTB Standard Time": "Europe/Bucharest",
    "Georgian Standard Time": "Asia/Tbilisi",
    "Greenland Standard Time": "America/Godthab",
    "Greenwich Standard Time": "Atlantic/Reykjavik",
    "Haiti Standard Time": "America/Port-au-Prince",
    "Hawaiian Standard Time": "Pacific/Honolulu",
    "India Standard Time": "Asia/Calcutta",
    "Iran Standard Time": "Asia/Tehran",
    "Israel Standard Time": "Asia/Jerusalem",
    "Jordan Standard Time": "Asia/Amman",
    "Kaliningrad Standard Time": "Europe/Kaliningrad",
    "Korea Standard Time": "Asia/Seoul",
    "Libya Standard Time": "Africa/Tripoli",
    "Line Islands Standard Time": "Pacific/Kiritimati",
    "Magadan Standard Time": "Asia/Magadan",
    "Mauritius Standard Time": "Indian/Mauritius",
    "Middle East Standard Time": "Asia/Beirut",
    "Montevideo Standard Time": "America/Montevideo",
    "Morocco Standard Time": "Africa/Casablanca",
    "Mountain Standard Time": "America/Denver",
    "Mountain Standard Time (Mexico)": "America/Mazatlan",
    "Myanmar Standard Time": "Asia/Rangoon",
    "N. Central Asia Standard Time": "Asia/Novosibirsk",
    "Namibia Standard Time": "Africa/Windhoek",
    "Nepal Standard Time": "Asia/Katmandu",
    "New Zealand Standard Time": "Pacific/Auckland",
    "Newfoundland Standard Time": "America/St_Johns",
    "North Asia East Standard Time": "Asia/Irkutsk",
    "North Asia Standard Time": "Asia/Krasnoyarsk",
    "North Korea Standard Time": "Asia/Pyongyang",
    "Pacific SA Standard Time": "America/Santiago",
    "Pacific Standard Time": "America/Los_Angeles",
    "Pacific Standard Time (Mexico)": "America/Tijuana",
    "Pakistan Standard Time": "Asia/Karachi",
    "Paraguay Standard Time": "America/Asuncion",
    "Romance Standard Time": "Europe/Paris",
    "Russia Time Zone 3": "Europe/Samara",
    "Russian Standard Time": "Europe/Moscow",
    "SA Eastern Standard Time": "America/Cayenne",
    "SA Pacific Standard Time": "America/Bogota",
    "SA Western Standard Time": "America/La_Paz",
    "SE Asia Standard Time": "Asia/Bangkok",
    "Samoa Standard Time": "Pacific/Apia",
    "Singapore Standard Time": "Asia/Singapore",
    "South Africa Standard Time": "Africa/Johannesburg",
    "Sri Lanka Standard Time": "Asia/Colombo",
    "Syria Standard Time": "Asia/Damascus",
    "Taipei Standard Time": "Asia/Taipei",
    "Tasmania Standard Time": "Australia/Hobart",
    "Tokyo Standard Time": "Asia/Tokyo",
    "Tonga Standard Time": "Pacific/Tongatapu",
    "Turkey Standard Time": "Europe/Istanbul",
    "US Eastern Standard Time": "America/Indianapolis",
    "US Mountain Standard Time": "America/Phoenix",
    "UTC": "Etc/UTC",
    "Ulaanbaatar Standard Time": "Asia/Ulaanbaatar",
    "Venezuela Standard Time": "America/Caracas",
    "Vladivostok Standard Time": "Asia/Vladivostok",
    "W. Australia Standard Time": "Australia/Perth",
    "W. Central Africa Standard Time": "Africa/Lagos",
    "W. Europe Standard Time": "Europe/Berlin",
    "West Asia Standard Time": "Asia/Tashkent",
    "West Bank Standard Time": "Asia/Hebron",
    "West Pacific Standard Time": "Pacific/Port_Moresby",
    "Yakutsk Standard Time": "Asia/Yakutsk",
}

ZONE_BLOCK = r"(?is)BEGIN:VTIMEZONE.*?END:VTIMEZONE"
RULE_BLOCK = r"(?is)BEGIN:(?:STANDARD|DAYLIGHT)\b.*?END:(?:STANDARD|DAYLIGHT)\b"
TRANSITIONS = "map<string,array<struct<wall:timestamp_ntz,offset:int>>>"


@cache
def zone_names() -> list[str]:
    return sorted(zoneinfo.available_timezones())


def property_of(block: Column, name: str, group: int = 2) -> Column:
    """Value (group 2) or parameters (group 1) of a property; null when it is absent."""
    pattern = rf'(?im)^{name}((?:;(?:"[^"]*"|[^":])*)?):(.*?)\r?$'
    return F.when(block.rlike(pattern), F.regexp_extract(block, pattern, group))


def wall_time(value: Column) -> Column:
    """A DATE-TIME value as it stands on the wall; null for anything else."""
    stamp = F.regexp_replace(value, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2}).*$", "$1-$2-$3T$4:$5:$6")
    return F.when(value.rlike(r"^\d{8}T\d{6}"), stamp.try_cast("timestamp_ntz"))


def named_zone(tzid: Column) -> Column:
    """The IANA name that a TZID is or stands for; null for names of no list."""
    plain = F.regexp_replace(tzid, "^/", "")
    windows = F.create_map(*[F.lit(x) for x in chain.from_iterable(WINDOWS.items())])
    return F.when(plain.isin(zone_names()), plain).otherwise(F.try_element_at(windows, plain))


def _seconds(offset: Column) -> Column:
    """An offset such as -0330 or +023015 in seconds."""

    def part(group: int) -> Column:
        return F.coalesce(F.regexp_extract(offset, r"^([+-]?)(\d{2})(\d{2})(\d{2})?", group).try_cast("int"), F.lit(0))

    total = part(2) * 3600 + part(3) * 60 + part(4)
    return F.when(offset.startswith("-"), -total).otherwise(total)


def _in_year(rule: Column, first: Column, year: Column) -> Column:
    """The day of a year on which a yearly rule falls; the day of the first onset where the rule names none."""
    month = F.coalesce(F.regexp_extract(rule, r"(?i)BYMONTH=(\d+)", 1).try_cast("int"), F.month(first))
    nth = F.regexp_extract(rule, r"(?i)BYDAY=([+-]?\d+)[A-Z]{2}", 1).try_cast("int")
    weekday = F.upper(F.nullif(F.regexp_extract(rule, r"(?i)BYDAY=[+-]?\d*([A-Z]{2})", 1), F.lit("")))

    def from_day(day: Column) -> Column:
        """The first such weekday from a day on."""
        return F.call_function("next_day", F.date_sub(day, 1), weekday)

    numbered = F.regexp_extract(rule, r"(?i)BYMONTHDAY=(-?\d+)", 1).try_cast("int")
    opening = F.make_date(year, month, F.lit(1))
    closing = F.last_day(opening)
    from_start = F.date_add(from_day(opening), 7 * (nth - 1))
    from_end = F.date_add(from_day(F.date_sub(closing, 6)), 7 * (nth + 1))
    among = from_day(F.date_add(opening, numbered - 1))
    day = F.when(numbered < 0, F.date_add(closing, numbered + 1)).otherwise(F.date_add(opening, numbered - 1))
    found = (
        F.when(nth > 0, from_start)
        .when(nth < 0, from_end)
        .when(weekday.isNotNull() & numbered.isNotNull(), among)
        .when(numbered.isNotNull(), day)
        .otherwise(F.date_add(opening, F.dayofmonth(first) - 1))
    )
    return F.when(F.month(found) == month, found)


def zone_transitions(blocks: DataFrame) -> DataFrame:
    """``(file, tzid, wall, offset)`` from ``blocks(file, zone_block, first_year, last_year)``.

    ``wall`` is the wall time from which ``offset`` (seconds east) holds, for the years asked for and the ones
    around them. Times that a change skips or repeats belong to the offset before it. The first row of a zone
    holds for all times before its first change.
    """
    block, rule_text = F.col("zone_block"), F.col("rule_block")
    tzid = F.trim(property_of(block, "TZID"))
    rules = blocks.select("file", tzid.alias("tzid"), "first_year", "last_year", F.explode(F.regexp_extract_all(block, F.lit(RULE_BLOCK), F.lit(0))).alias("rule_block"))
    told = rules.select(
        "file", "tzid", "first_year", "last_year",
        wall_time(property_of(rule_text, "DTSTART")).alias("first"),
        property_of(rule_text, "RRULE").alias("rule"),
        F.split(F.coalesce(property_of(rule_text, "RDATE"), F.lit("")), ",").alias("dates"),
        _seconds(property_of(rule_text, "TZOFFSETFROM")).alias("before"),
        _seconds(property_of(rule_text, "TZOFFSETTO")).alias("offset"),
    ).filter("tzid is not null and first is not null")
    until = wall_time(F.concat(F.regexp_extract("rule", r"(?i)UNTIL=(\d{8})", 1), F.lit("T235959")))
    count = F.regexp_extract("rule", r"(?i)COUNT=(\d+)", 1).try_cast("int")
    step = F.coalesce(F.regexp_extract("rule", r"(?i)INTERVAL=(\d+)", 1).try_cast("int"), F.lit(1))
    opens = F.greatest(F.year("first") + 1, F.col("first_year") - 1)
    closes = F.least(F.col("last_year") + 1, F.year(until), F.year("first") + step * (count - 1))
    years = F.when(F.col("rule").isNotNull() & (opens <= closes), F.sequence(opens, closes)).otherwise(F.array().cast("array<int>"))
    clock = F.col("first") - F.to_date("first").cast("timestamp_ntz")
    yearly = F.transform(F.filter(years, lambda y: (y - F.year("first")) % step == 0), lambda y: _in_year(F.col("rule"), F.col("first"), y).cast("timestamp_ntz") + clock)
    named = F.transform("dates", wall_time)
    onsets = F.concat(F.array(F.col("first")), F.filter(yearly, lambda x: x.isNotNull() & (until.isNull() | (x <= until))), F.filter(named, lambda x: x.isNotNull()))
    # A clock set forward skips an hour, which still belongs to the time before.
    shift = F.make_dt_interval(secs=F.greatest(F.col("offset") - F.col("before"), F.lit(0)))
    changes = told.select("file", "tzid", "before", "offset", F.explode(onsets).alias("onset"), shift.alias("shift"))
    changes = changes.select("file", "tzid", "before", "offset", (F.col("onset") + F.col("shift")).alias("wall"))
    opening = changes.groupBy("file", "tzid").agg(F.min_by("before", "wall").alias("offset"))
    start = F.lit("0001-01-01").cast("timestamp_ntz")
    return opening.select("file", "tzid", start.alias("wall"), "offset").union(changes.select("file", "tzid", "wall", "offset")).distinct()


def zone_table(blocks: DataFrame) -> DataFrame:
    """One row for each file: ``zones``, its zones' transitions by TZID in order; a few rows for each zone and year."""
    entry = F.struct("wall", "offset")
    zones = zone_transitions(blocks).groupBy("file", "tzid").agg(F.array_sort(F.collect_list(entry)).alias("changes"))
    return zones.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("tzid", "changes"))).alias("zones"))


def to_utc(wall: Column, tzid: Column, zones: Column) -> Column:
    """A local time in UTC: by its IANA or Windows zone, else by the file's own rules, else as it is."""
    known = named_zone(tzid)
    own = F.try_element_at(zones, tzid)
    offset = F.try_element_at(F.filter(own, lambda change: change["wall"] <= wall), F.lit(-1))["offset"]
    return (
        F.when(known.isNotNull(), F.convert_timezone(known, F.lit("UTC"), wall))
        .when(offset.isNotNull(), wall - F.make_dt_interval(secs=offset))
        .otherwise(wall)
    )
