"""Text rules for titles, notes and places, as Column expressions.

Patterns use Java syntax. ``(?U)`` makes ``\\w``, ``\\s`` and ``\\b`` Unicode-aware
and ``(?d)`` leaves "\\n" as the only line end. Case is folded with ``lower``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: patterns that decide what counts as a place or a name ---
JUNK_LOCATION = (
    r"(?iU)zoom\.us|meet\.google\.com|teams\.microsoft\.com|teams\.live\.com|webex\.com"
    r"|^https?://|^[\d\s()+.\-]{7,}$"
)
NAME_LIKE = r"(?U)^[A-Z][\w.'’-]*(\s+[A-Z][\w.'’-]*)*$"
TRAILING_DECORATION = r"(?dU)[\s!?.…\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]+$"
GUEST_LIST = r"(?idU)\bwith\s+(.+)$"
TITLE_BEFORE_GUESTS = r"(?idU)^((?s:.*?))\bwith\s+.+$"
AND_BETWEEN_NAMES = r"(?iU)\s*,?\s+and\s+"
NOTE_LINE = r"(?U)^([^:]{1,31}):\s*((?s:.+))$"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
# --- end of fixed values ---


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def is_junk_location(location: Column) -> Column:
    return location.rlike(JUNK_LOCATION)


def people_from_title(title: Column) -> Column:
    """Names listed after "with" at the end of a title, in title order."""
    listed = F.regexp_extract(F.coalesce(title, F.lit("")), GUEST_LIST, 1)
    listed = F.regexp_replace(listed, TRAILING_DECORATION, "")
    listed = F.regexp_replace(listed, AND_BETWEEN_NAMES, ", ")
    names = F.transform(F.split(listed, ","), lambda name: F.regexp_replace(strip(name), r"[.,]+\z", ""))
    return F.filter(names, lambda name: name.rlike(NAME_LIKE))


def strip_with_suffix(title: Column) -> Column:
    """Title without its trailing guest list; kept as it is when no guest looks like a name."""
    bare = rstrip(F.regexp_extract(title, TITLE_BEFORE_GUESTS, 1))
    return F.when(F.size(people_from_title(title)) > 0, bare).otherwise(title)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_note_tags(notes: Column) -> Column:
    """``Key: a, b`` lines of a note as map<string, array<string>>.

    Keys are trimmed and lower-cased; repeated keys append their values.
    """

    def tag(line: Column) -> Column:
        values = F.filter(
            F.transform(F.split(F.regexp_extract(line, NOTE_LINE, 2), ","), strip), lambda value: value != ""
        )
        key = F.lower(strip(F.regexp_extract(line, NOTE_LINE, 1)))
        return F.struct(key.alias("key"), values.alias("values"))

    def as_map(tagged: Column) -> Column:
        keys = F.array_distinct(F.transform(tagged, lambda entry: entry["key"]))
        return F.map_from_entries(F.transform(keys, lambda key: F.struct(key, F.flatten(_values_of(tagged, key)))))

    lines = F.transform(F.split(F.coalesce(notes, F.lit("")), LINE_BREAKS), strip)
    tagged = F.filter(
        F.transform(F.filter(lines, lambda line: line.rlike(NOTE_LINE)), tag),
        lambda entry: (entry["key"] != "") & (F.size(entry["values"]) > 0),
    )
    return bind(tagged, as_map)


def _values_of(tagged: Column, key: Column) -> Column:
    return F.transform(F.filter(tagged, lambda entry: entry["key"] == key), lambda entry: entry["values"])


def tag_values(note_tags: Column, key: str) -> Column:
    """Values of one note tag; empty when the tag or the map is missing."""
    empty = F.array().cast("array<string>")
    return F.coalesce(F.try_element_at(note_tags, F.lit(key)), empty)


def first_tag(note_tags: Column, key: str) -> Column:
    return F.get(tag_values(note_tags, key), F.lit(0))


def attendee_name(common_name: Column, address: Column) -> Column:
    return F.coalesce(none_if_empty(common_name), F.replace(address, F.lit("mailto:"), F.lit("")))


def split_address_lines(location: Column) -> Column:
    """Name / street / city and state / postcode and country of a one-line address.

    The name ends at the first digit, the street at the next comma and the city
    at the next digit; parts that are empty are left out.
    """
    tidy = lambda part: F.regexp_replace(strip(part), r"(?U)[,\s]+\z", "")
    name = F.regexp_extract(location, r"^(?s)([^0-9]*)", 1)
    rest = F.regexp_extract(location, r"^(?s)[^0-9]*(.*)$", 1)
    street = F.regexp_extract(rest, r"^(?s)([^,]*)", 1)
    after = F.regexp_replace(F.regexp_extract(rest, r"^(?s)[^,]*,(.*)$", 1), r"(?U)^[,\s]+", "")
    city = F.regexp_extract(after, r"^(?s)([^0-9]*)", 1)
    tail = F.regexp_extract(after, r"^(?s)[^0-9]*(.*)$", 1)
    city_line = F.when(tail == "", strip(city)).otherwise(tidy(city))
    lines = F.array(tidy(name), strip(street), city_line, strip(tail))
    return F.when(location.rlike("[0-9]"), F.filter(lines, lambda line: line != "")).otherwise(F.array(location))
