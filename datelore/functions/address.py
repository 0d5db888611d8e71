"""Rewriting one-line postal addresses into forms a gazetteer knows.

Every function maps a text Column to a text Column; "strip" functions return null
when they change nothing. The patterns run on Java's engine, ``(?U)`` for Unicode
classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from datelore.functions.text import bind, strip

# --- Fixed values: words and patterns of postal addresses ---
STREET_SUFFIXES = (
    "St|Street|Ave|Avenue|Avenida|Blvd|Boulevard|Dr|Drive|Rd|Road|Ln|Lane|Way|Ct|Court|"
    "Pl|Place|Plaza|Cir|Circle|Pkwy|Parkway|Ter|Terrace|Hwy|Highway|Sq|Square|Row|Walk|"
    "Trail|Path|Loop|Camino|Paseo|Calle|Via"
)
DIRECTIONS = "NE|NW|SE|SW|N|S|E|W"
STREET_END = rf"(?:{STREET_SUFFIXES})(?:\s+(?:{DIRECTIONS})\.?\b)?"
CITY = r"[A-Z][A-Za-z]+(?:\s[A-Z][A-Za-z]+)*"
NO_COMMAS = rf"\b({STREET_END})\s+({CITY})\s+([A-Z]{{2}})(\s+\d{{5}}(?:-\d{{4}})?)?\b"
NO_CITY_COMMA = rf"\b({STREET_END})\s+({CITY}),\s*([A-Z]{{2}})\b"
NO_STATE_COMMA = rf",\s*({CITY})\s+([A-Z]{{2}})\b"
NO_COUNTRY_COMMA = r"([^\s,])\s+(United States|USA|Canada)\b"
ADDRESS_TAIL = r",\s*[A-Za-z][A-Za-z .]*,\s*[A-Z]{2}\s*(?:\d{5}(?:-\d{4})?)?,\s*(?:United States|USA)\s*"
CITY_IN_TAIL = ADDRESS_TAIL.replace("[A-Za-z][A-Za-z .]*", "([A-Za-z][A-Za-z .]*?)\\s*", 1)
UNIT_CLAUSE = (
    r",?\s*(?:(?:Unit|Ste|Suite|Apt|Apartment|Bldg|Building|Fl|Floor|Rm|Room)\b\.?\s*#?|#)\s*[\w&/-]+"
)
CONTAINING_CITY = "Los Angeles"
CONTAINED_STATE = "CA"
CONTAINED_PLACES = [
    "van nuys", "pacific palisades", "woodland hills", "north hollywood",
    "sherman oaks", "studio city", "encino", "tarzana", "reseda",
    "canoga park", "winnetka", "west hills", "chatsworth", "northridge",
    "granada hills", "porter ranch", "sylmar", "sun valley", "panorama city",
    "mission hills", "arleta", "lake balboa", "valley glen", "toluca lake",
    "eagle rock", "highland park", "mount washington", "atwater village",
    "silver lake", "echo park", "los feliz", "hollywood", "west adams",
    "mar vista", "playa vista", "playa del rey", "westchester", "venice",
    "brentwood", "bel air", "westwood", "san pedro", "wilmington",
    "harbor city", "sunland", "tujunga", "shadow hills", "west hollywood",
]
LABEL_BUSINESS = "stripping the likely business name"
LABEL_UNIT = "dropping the unit/suite"
LABEL_BUSINESS_AND_UNIT = "stripping the likely business name and dropping the unit/suite"
LABEL_DIRECTION = "dropping the street's directional suffix"
LABEL_BUSINESS_AND_DIRECTION = "stripping the likely business name and dropping the directional suffix"
LABEL_NAME_AND_CITY = "trying just the name and city"
LABEL_CONTAINING_CITY = "trying the containing city (Los Angeles) instead of the neighborhood"
# --- end of fixed values ---


def normalize_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def insert_missing_commas(text: Column) -> Column:
    """Commas between street, city, state and country where only blanks separate them."""
    text = F.regexp_replace(text, f"(?U){NO_COMMAS}", "$1, $2, $3$4")
    text = F.regexp_replace(text, f"(?U){NO_CITY_COMMA}", "$1, $2, $3")
    text = F.regexp_replace(text, f"(?U){NO_STATE_COMMA}", ", $1, $2")
    return F.regexp_replace(text, f"(?iU){NO_COUNTRY_COMMA}", "$1, $2")


def clean_address(location: Column) -> Column:
    return insert_missing_commas(normalize_whitespace(location))


def _before_tail(text: Column) -> Column:
    return F.regexp_extract(text, rf"(?isU)^(.*?){ADDRESS_TAIL}$", 1)


def strip_business_name(text: Column) -> Column:
    """Address from its house number on: the last bare number, not at the very start,
    that a street suffix still follows before the city, state and country."""
    # The greedy prefix leaves the last such number for the group.
    numbered = rf"(?isU)^.+\b(\d+\b.*\b(?:{STREET_SUFFIXES})\b.*)$"

    def join_tail(head: Column) -> Column:
        street = F.regexp_extract(head, numbered, 1)
        return F.when(street != "", F.concat(street, F.substr(text, F.length(head) + 1)))

    return bind(_before_tail(text), join_tail)


def business_name_and_city(text: Column) -> Column:
    """ "Name, City" from an address that starts with the name of a place."""
    head = normalize_whitespace(F.regexp_replace(_before_tail(text), f"(?iU){UNIT_CLAUSE}", ""))
    name = strip(F.regexp_extract(head, r"(?sU)^(.+)\b\d+\b.*$", 1))
    city = strip(F.regexp_extract(text, rf"(?isU){CITY_IN_TAIL}$", 1))
    result = F.concat_ws(", ", name, city)
    return F.when((name != "") & (city != "") & (result != text), result)


def strip_unit(text: Column) -> Column:
    """Address without its first unit, suite, floor or room clause; commas are repaired again."""
    pattern = rf"(?isU)^(.*?){UNIT_CLAUSE}"
    return bind(
        F.regexp_replace(text, pattern, "$1"),
        lambda shorter: F.when(shorter != text, insert_missing_commas(normalize_whitespace(shorter))),
    )


def strip_street_direction(text: Column) -> Column:
    """Address without the compass direction after its first street suffix that has one."""
    direction = rf"\b({STREET_SUFFIXES})\s+(?:{DIRECTIONS})\.?\b"
    return F.nullif(F.regexp_replace(text, rf"(?isU)^(.*?){direction}", "$1$2"), text)


def use_containing_city(text: Column) -> Column:
    """Address with the first known neighbourhood used as its city replaced by the city around it."""
    names = "|".join(sorted(CONTAINED_PLACES, key=len, reverse=True))
    place = rf"\b(?:{names})(?=\s*,\s*{CONTAINED_STATE}\b)"
    return F.nullif(F.regexp_replace(text, rf"(?isU)^(.*?){place}", f"$1{CONTAINING_CITY}"), text)
