import datetime as dt

import pytest
from pyspark.sql import functions as F

from datelore.functions import address as ad
from datelore.functions import geo as geo_fn
from datelore.functions import text, timebins
from datelore.operators import resolve
from datelore.operators.filters import is_complete_address
from datelore.operators.sequences import hour_of
from datelore.schema import parse_utc

COL = F.col("value")


def apply(spark, expression, values):
    """Results of one expression over text values, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), "n int, value string")
    return [row[0] for row in rows.orderBy("n").select(expression).collect()]


def test_junk_locations(spark):
    junk = [
        "https://zoom.us/my/room-77",
        "https://eu9.zoom.us/w/55?x=1",
        "+44 20 7946 0018",
        "(030) 901-8200",
        "https://meet.google.com/xyz",
        "Teams.Microsoft.com/l/x",
    ]
    real = ["Elm Court, Springfield", "12345", "Room 030-901-8200"]
    assert apply(spark, text.is_junk_location(COL), junk + real) == [True] * len(junk) + [False] * len(real)


@pytest.mark.parametrize(
    "title, names",
    [
        ("Chess with Ravi", ["Ravi"]),
        ("Hike with Mina and Tomás", ["Mina", "Tomás"]),
        ("Board meeting with Ursula Kent, Per Holm, and DeShawn", ["Ursula Kent", "Per Holm", "DeShawn"]),
        ("Rehearsal with the string section", []),
        ("Quiz with Mina, Ravi, and the neighbours", ["Mina", "Ravi"]),
        ("Brunch with Niamh O’Dowd", ["Niamh O’Dowd"]),
        ("Swim with Ravi, and Per \U0001f3ca", ["Ravi", "Per"]),
        ("Run WITH Noëlle K. and Raúl.", ["Noëlle K", "Raúl"]),
        ("withdrawal", []),
        ("", []),
        (None, []),
    ],
)
def test_people_from_title(spark, title, names):
    assert apply(spark, text.people_from_title(COL), [title]) == [names]


def test_strip_with_suffix(spark):
    titles = ["Piano and Tea with Ravi, Mina", "Budget review with the auditors", "Solo", None, "with Per"]
    assert apply(spark, text.strip_with_suffix(COL), titles) == ["Piano and Tea", "Budget review with the auditors", "Solo", None, ""]


def test_note_tags(spark):
    notes = "Category: Gym\r\nPeople: Ann , , Bo\nfree text\npeople: Cy\n: none\nempty: ,\n" + "k" * 32 + ": long\nurl: http://x"
    [tags] = apply(spark, text.parse_note_tags(COL), [notes])
    assert tags == {"category": ["Gym"], "people": ["Ann", "Bo", "Cy"], "url": ["http://x"]}
    assert apply(spark, text.parse_note_tags(COL), [None, ""]) == [{}, {}]


def test_address_lines(spark):
    lines = apply(
        spark,
        text.split_address_lines(COL),
        ["Mill House Lofts 480 Quarry Lane, Hood River, OR 97031, United States", "480 Quarry Lane, Y", "Cabin", "Pool 3"],
    )
    assert lines == [
        ["Mill House Lofts", "480 Quarry Lane", "Hood River, OR", "97031, United States"],
        ["480 Quarry Lane", "Y"],
        ["Cabin"],
        ["Pool", "3"],
    ]


def test_parse_utc_ignores_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        values = ["2024-11-03T05:30:00Z", "2024-11-03T09:30:00+02:00", "2024-03-10", "2024-01-01T00:00:00", "nonsense", None]
        got = apply(spark, parse_utc(COL), values)
        chunk = apply(spark, hour_of(parse_utc(COL)), ["1970-01-02T03:59:59Z", "2024-03-10T07:30:00Z"])
        hours = apply(spark, timebins.hours_between(parse_utc(COL), parse_utc(F.lit("2024-11-04T05:30:00Z"))), values[:1])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [
        dt.datetime(2024, 11, 3, 5, 30),
        dt.datetime(2024, 11, 3, 7, 30),
        dt.datetime(2024, 3, 10),
        dt.datetime(2024, 1, 1),
        None,
        None,
    ]
    assert hours == [24.0]
    assert chunk == [27, (dt.date(2024, 3, 10) - dt.date(1970, 1, 1)).days * 24 + 7]


def test_micros_between_is_signed_and_exact(spark):
    start, end = parse_utc(COL), parse_utc(F.lit("2024-01-02T00:00:00Z"))
    values = ["2024-01-01T23:59:59.999999Z", "2024-01-05T01:02:03.000004Z", "2024-01-02T00:00:00Z"]
    assert apply(spark, timebins.micros_between(start, end), values) == [1, -(3 * 86_400 + 3_723) * 1_000_000 - 4, 0]


def test_week_ending_is_the_sunday_on_or_after(spark):
    values = ["2024-01-07T10:00:00Z", "2024-01-08T00:00:00Z", "2024-01-13T23:00:00Z"]
    expected = [dt.date(2024, 1, 7), dt.date(2024, 1, 14), dt.date(2024, 1, 14)]
    assert apply(spark, timebins.week_ending(parse_utc(COL)), values) == expected


def test_cadence_and_status(spark):
    days = ["1", "7", "14", "30", "90", "365"]
    labels = ["daily", "weekly", "biweekly", "monthly", "quarterly", "yearly"]
    assert apply(spark, timebins.cadence_label(COL.cast("double")), days) == labels
    status = timebins.recurrence_status(COL.cast("double"), F.lit(10.0))
    assert apply(spark, status, ["15", "30", "31"]) == ["active", "slowing down", "stopped"]


def test_people_table_labels(spark):
    days = COL.cast("bigint")
    assert apply(spark, timebins.last_seen_bucket(days), ["14", "45", "46"]) == ["good", "warning", "critical"]
    assert apply(spark, timebins.tenure_label(days), ["29", "60", "840"]) == ["29d", "2mo", "2.3yr"]
    slope = COL.cast("double")
    assert apply(spark, timebins.trend_direction(slope), ["0.01", "2", "-1"]) == ["flat", "growing", "fading"]
    assert apply(spark, timebins.trend_strength(slope), ["-10", "2.5"]) == [1.0, 0.5]


@pytest.mark.parametrize(
    "osm_class, osm_type, label",
    [
        ("place", "house", "residential"),
        ("building", "apartments", "residential"),
        ("shop", "supermarket", "commercial"),
        ("office", "company", "commercial"),
        ("amenity", "restaurant", "commercial"),
        ("amenity", "school", "public"),
        ("amenity", "arts_centre", "recreational"),
        ("amenity", "something_new", "public"),
        ("leisure", "park", "recreational"),
        ("tourism", "museum", "recreational"),
        (None, None, "unknown"),
        ("highway", "residential", "unknown"),
        ("amenity", None, "public"),
    ],
)
def test_place_type(spark, osm_class, osm_type, label):
    kind = geo_fn.classify_place(F.lit(osm_class).cast("string"), F.lit(osm_type).cast("string"))
    assert apply(spark, kind, ["x"]) == [label]


def test_region_label(spark):
    none = F.lit(None).cast("string")
    lines = [
        "Harbour Books, 12 Pier Road, Astoria, Oregon, 97103, United States",
        "Lake Inn, Bled, Slovenia",
        "Lemuria",
        "Andorra, Andorra",
        None,
    ]
    expected = ["Astoria, United States", "Lake Inn, Slovenia", "Lemuria", "Andorra", None]
    assert apply(spark, geo_fn.region_label(none, none, COL), lines) == expected
    assert apply(spark, geo_fn.region_label(F.lit("Rome"), F.lit("Italy"), COL), ["x, y"]) == ["Rome, Italy"]
    assert apply(spark, geo_fn.region_label(F.lit(""), F.lit("Italy"), COL), ["x, y"]) == ["Italy"]


def test_structured_address_fields(spark):
    address = F.from_json(COL, "city string, town string, village string, municipality string, county string, suburb string, neighbourhood string, quarter string, city_district string, borough string")
    got = apply(spark, F.struct(geo_fn.address_city(address), geo_fn.address_neighbourhood(address)), ['{"city": "", "town": "Ely", "quarter": "Q", "borough": "B"}', "{}"])
    assert [tuple(row) for row in got] == [("Ely", "Q"), (None, None)]


@pytest.mark.parametrize(
    "address, fixed",
    [
        # No comma at all, with and without a post code.
        ("58 Larkspur Lane Hood River OR 97031", "58 Larkspur Lane, Hood River, OR 97031"),
        ("9 Foundry Plaza Erie PA", "9 Foundry Plaza, Erie, PA"),
        # Only the comma before the city is missing; a name in front stays.
        ("3 Ferry Road Astoria, OR, United States", "3 Ferry Road, Astoria, OR, United States"),
        ("Tin Shed 77 Canal Walk Troy, NY 12180, United States", "Tin Shed 77 Canal Walk, Troy, NY 12180, United States"),
        # Only the comma before the state is missing.
        ("77 Canal Walk, Troy NY 12180, United States", "77 Canal Walk, Troy, NY 12180, United States"),
        # A direction belongs to the street.
        ("640 Aspen Pkwy SE Salem OR 97301", "640 Aspen Pkwy SE, Salem, OR 97301"),
        ("640 Aspen Pkwy SE Salem, OR", "640 Aspen Pkwy SE, Salem, OR"),
        # The country needs one too; a finished address stays.
        ("2 Orchard Loop, Troy, NY 12180 United States", "2 Orchard Loop, Troy, NY 12180, United States"),
        ("2 Orchard Loop, Troy, NY 12180, United States", "2 Orchard Loop, Troy, NY 12180, United States"),
    ],
)
def test_insert_missing_commas(spark, address, fixed):
    assert apply(spark, ad.insert_missing_commas(COL), [address]) == [fixed]


def test_normalize_whitespace(spark):
    values = ["Stone Barn\n6 Chapel Path", "x \t y\u00a0\u00a0z", "\n edge "]
    assert apply(spark, ad.normalize_whitespace(COL), values) == ["Stone Barn 6 Chapel Path", "x y z", "edge"]


@pytest.mark.parametrize(
    "address, street",
    [
        ("Stone Barn 6 Chapel Path, Hood River, OR 97031, United States", "6 Chapel Path, Hood River, OR 97031, United States"),
        # Names that hold or begin with numbers of their own.
        ("44 Knots Yarn 1201 Quarry Lane, Suite C, Erie, PA 16501, United States", "1201 Quarry Lane, Suite C, Erie, PA 16501, United States"),
        ("8th Note Studio 305 N 9th Street, Erie, PA 16501, United States", "305 N 9th Street, Erie, PA 16501, United States"),
        # Nothing in front of the number, or no address behind it.
        ("6 Chapel Path Hood River, OR, United States", None),
        ("6 S 12th Street Apt 4 Erie, PA, United States", None),
        ("Gate 12", None),
    ],
)
def test_strip_business_name(spark, address, street):
    assert apply(spark, ad.strip_business_name(COL), [address]) == [street]


@pytest.mark.parametrize(
    "address, shorter",
    [
        ("305 N 9th Street, Unit 7, Erie, PA 16501, United States", "305 N 9th Street, Erie, PA 16501, United States"),
        ("1201 Quarry Lane, Ste 4B, Erie, PA 16501, United States", "1201 Quarry Lane, Erie, PA 16501, United States"),
        ("1201 Quarry Lane Apt. 12, Erie, PA, United States", "1201 Quarry Lane, Erie, PA, United States"),
        ("77 Canal Walk Suite #3 Troy, NY, United States", "77 Canal Walk, Troy, NY, United States"),
        ("77 Canal Walk, Unit R&S, Troy, NY 12180, United States", "77 Canal Walk, Troy, NY 12180, United States"),
        ("77 Canal Walk, Troy, NY 12180, United States", None),
    ],
)
def test_strip_unit(spark, address, shorter):
    assert apply(spark, ad.strip_unit(COL), [address]) == [shorter]


def test_other_rewrites(spark):
    streets = ["640 Aspen Pkwy SE, Salem, OR 97301", "18 Mill Court N, Troy, NY", "18 Mill Court, Troy"]
    assert apply(spark, ad.strip_street_direction(COL), streets) == ["640 Aspen Pkwy, Salem, OR 97301", "18 Mill Court, Troy, NY", None]
    named = [
        "Stone Barn 6 Chapel Path, Hood River, OR 97031, United States",
        "Tin Shed 77 Canal Walk, Unit 2, Troy, NY 12180, United States",
        "6 Chapel Path, Hood River, OR 97031, United States",
    ]
    assert apply(spark, ad.business_name_and_city(COL), named) == ["Stone Barn, Hood River", "Tin Shed, Troy", None]
    inside = ["31 Cedar Place, Encino, CA, United States", "31 Cedar Place, Fresno, CA, United States"]
    assert apply(spark, ad.use_containing_city(COL), inside) == ["31 Cedar Place, Los Angeles, CA, United States", None]
    complete = ["18 Mill Court, Troy, NY 12180", "Some hall, Canada", "South Lawn", "Gate 12"]
    assert apply(spark, is_complete_address(COL), complete) == [True, True, False, False]


def tried(spark, query):
    rows = spark.createDataFrame([(query,)], "query string")
    [row] = resolve.retry_queries(rows, "query").collect()
    return [(entry["label"], entry["query"]) for entry in row["retries"]]


def test_retry_order(spark):
    options = tried(spark, "Tin Shed 77 Canal Walk, Unit 2, Troy, NY 12180, United States")
    assert options[:2] == [
        (ad.LABEL_BUSINESS, "77 Canal Walk, Unit 2, Troy, NY 12180, United States"),
        (ad.LABEL_UNIT, "77 Canal Walk, Troy, NY 12180, United States"),
    ]
    options = dict(tried(spark, "Studio 15 Birch Terrace #B7 Hood River, OR 97031, United States"))
    assert options[ad.LABEL_BUSINESS_AND_UNIT] == "15 Birch Terrace, Hood River, OR 97031, United States"
    options = dict(tried(spark, "Saltbox 640 Aspen Pkwy SE, Unit 9, Salem, OR 97301, United States"))
    assert options[ad.LABEL_UNIT] == "640 Aspen Pkwy SE, Salem, OR 97301, United States"
    assert options[ad.LABEL_DIRECTION] == "640 Aspen Pkwy, Salem, OR 97301, United States"
    options = dict(tried(spark, "31 Cedar Place, Encino, CA, United States"))
    assert options == {ad.LABEL_CONTAINING_CITY: "31 Cedar Place, Los Angeles, CA, United States"}
    options = dict(tried(spark, "Stone Barn 6 Chapel Path, Hood River, OR 97031, United States"))
    assert options[ad.LABEL_NAME_AND_CITY] == "Stone Barn, Hood River"

