import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from datelore.operators import dedupe, filters
from datelore.schema import EVENT_COLUMNS, RAW_EVENT
from datelore.sources import events as ev
from datelore.sources import geo, ics, manifest, records

ICS = """BEGIN:VCALENDAR\r
VERSION:2.0\r
X-WR-CALNAME:Choir and boats\r
BEGIN:VEVENT\r
UID:r-77\r
SUMMARY:Rowing wi\r
 th Mina\r
DTSTART:20230518T061500Z\r
DTEND:20230518T074500Z\r
LOCATION:Boathouse 2\\, Astoria\r
DESCRIPTION:People: Mina\\, Per\\nCategory: Sport\r
ATTENDEE;CN=Mina Sato:mailto:mina@rowing.example\r
ATTENDEE;ROLE=OPT-PARTICIPANT;CN="Holm, Per":mailto:per@rowing.example\r
ATTENDEE:mailto:cox@rowing.example\r
RRULE:FREQ=MONTHLY\r
URL:https://rowing.example/77\r
BEGIN:VALARM\r
DESCRIPTION:Bring oars\r
TRIGGER:-PT1H\r
END:VALARM\r
END:VEVENT\r
BEGIN:VEVENT\r
UID:regatta\r
SUMMARY:Regatta weekend\r
DTSTART;VALUE=DATE:20230610\r
DTEND;VALUE=DATE:20230612\r
END:VEVENT\r
BEGIN:VEVENT\r
SUMMARY:Evensong\r
DTSTART;TZID=Europe/Paris:20230115T180000\r
END:VEVENT\r
BEGIN:VEVENT\r
UID:undated\r
SUMMARY:Some day\r
END:VEVENT\r
END:VCALENDAR\r
"""
OTHER = "BEGIN:VCALENDAR\nVERSION:2.0\nBEGIN:VEVENT\nUID:t9\nSUMMARY:Tuning\nDTSTART:20230201T080000Z\nDTEND:20230201T081000Z\nEND:VEVENT\nEND:VCALENDAR\n"


def raw(i, title, start="2024-01-01T19:00:00Z", end="2024-01-01T20:00:00Z", **more):
    record = {
        "id": f"evt-{i}", "title": title, "notes": None, "location": None, "startDate": start, "endDate": end,
        "isAllDay": False, "calendarTitle": "Social", "calendarColorHex": None, "attendees": [],
        "isRecurring": False, "url": None, "noteTags": {},
    }
    return {**record, **more}


def load(spark, rows):
    return spark.createDataFrame([tuple(row[f] for f in RAW_EVENT.fieldNames()) for row in rows], RAW_EVENT)


def people_of(spark, rows):
    return {row.id: row.people for row in ev.normalize_events(load(spark, rows)).collect()}


def test_ics_records(spark, tmp_path):
    (tmp_path / "a.ics").write_text(ICS)
    (tmp_path / "b.ics").write_text(OTHER)
    rows = {row.title: row for row in ics.read_ics(spark, str(tmp_path / "*.ics"), "src1", "Fallback").collect()}
    assert set(rows) == {"Rowing with Mina", "Regatta weekend", "Evensong", "Tuning"}
    rowing = rows["Rowing with Mina"]
    assert rowing.id == "src1:r-77" and rowing.calendarTitle == "Choir and boats"
    assert rowing.location == "Boathouse 2, Astoria" and rowing.isRecurring and not rowing.isAllDay
    assert (rowing.startDate, rowing.endDate) == ("2023-05-18T06:15:00Z", "2023-05-18T07:45:00Z")
    assert rowing.attendees == ["Mina Sato", "Holm, Per", "cox@rowing.example"]
    assert rowing.noteTags == {"category": ["Sport"], "people": ["Mina", "Per"]}
    assert rowing.url == "https://rowing.example/77"
    regatta = rows["Regatta weekend"]
    assert regatta.isAllDay and regatta.startDate == "2023-06-10T00:00:00Z" and regatta.attendees == [] and regatta.noteTags == {}
    song = rows["Evensong"]
    assert song.id == "src1:src1-2" and song.startDate == song.endDate == "2023-01-15T17:00:00Z"
    assert rows["Tuning"].calendarTitle == "Fallback"


def test_ics_file_split_into_blocks(spark, tmp_path):
    """Positions count across the blocks of one file."""
    body = "".join(
        f"BEGIN:VEVENT\nSUMMARY:Event {i}\nDTSTART:20240102T170000Z\nDESCRIPTION:{'x' * 200}\nEND:VEVENT\n" for i in range(400)
    )
    (tmp_path / "big.ics").write_text("BEGIN:VCALENDAR\nX-WR-CALNAME:Big\n" + body + "END:VCALENDAR\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = ics.read_ics(spark, str(tmp_path / "big.ics"), "s", "d").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(row.title, row.id) for row in rows} == {(f"Event {i}", f"s:s-{i}") for i in range(400)}
    assert {row.calendarTitle for row in rows} == {"Big"}


def test_ics_flows_into_the_event_table(spark, tmp_path):
    (tmp_path / "a.ics").write_text(ICS)
    table = ev.normalize_events(ics.read_ics(spark, str(tmp_path / "a.ics"), "s", "d"))
    rowing = table.filter(F.col("title") == "Rowing with Mina").first()
    assert table.columns == EVENT_COLUMNS and rowing.category == "Sport"
    # In a group the bare first name becomes the full form used elsewhere.
    assert rowing.people == ["Holm, Per", "Mina Sato", "Per", "cox@rowing.example"]


@pytest.mark.parametrize("layout", ["array", "lines"])
def test_read_json_layouts(spark, tmp_path, layout):
    rows = [raw(1, "Dinner with Ann"), {k: v for k, v in raw(2, "Walk").items() if k != "calendarColorHex"}]
    path = tmp_path / "events.json"
    path.write_text(json.dumps(rows) if layout == "array" else "\n".join(json.dumps(row) for row in rows))
    table = ev.normalize_events(ev.read_events(spark, str(path), layout))
    assert {(row.title, tuple(row.people), row.calendar_color) for row in table.collect()} == {
        ("Dinner with Ann", ("Ann",), None),
        ("Walk", (), None),
    }
    uploaded = ev.read_uploaded_events(spark, str(path), "src", layout)
    assert {row.id for row in uploaded.collect()} == {"src:evt-1", "src:evt-2"}


def test_empty_input_keeps_the_schema(spark):
    table = ev.normalize_events(load(spark, []))
    assert table.columns == EVENT_COLUMNS and table.count() == 0


def test_normalized_columns(spark):
    rows = [
        raw(1, "Gym", noteTags={"category": ["Fitness"], "location": ["Nopa"], "with": ["Zed"]}, location="https://zoom.us/j/1", attendees=["Ann Lee"]),
        raw(2, "Call", location="+1 415-555-0100", start="2024-03-10T23:30:00-05:00", end="2024-03-11T05:00:00Z", noteTags=None),
    ]
    gym, call = ev.normalize_events(load(spark, [{**rows[0]}, {**rows[1], "startDate": "2024-03-10T23:30:00-05:00", "endDate": "2024-03-11T05:00:00Z"}])).orderBy("id").collect()
    assert (gym.category, gym.location, gym.people, gym.season, gym.weekday, gym.week) == ("Fitness", "Nopa", ["Ann Lee", "Zed"], "winter", "Monday", 1)
    assert (call.category, call.location, call.start, call.duration_hours) == ("Social", None, dt.datetime(2024, 3, 11, 4, 30), 0.5)


def test_bare_first_name_in_group_gets_most_common_full_name(spark):
    rows = [
        raw(1, "Dinner with Iris Novak"),
        raw(2, "Dinner with Iris Novak"),
        raw(3, "Coffee with Iris Okafor"),
        raw(4, "Game night with Iris, Tomek"),
        raw(5, "Coffee with Iris"),
        raw(6, "Game night with Iris, Iris Novak, Tomek"),
    ]
    people = people_of(spark, rows)
    assert people["evt-4"] == ["Iris Novak", "Tomek"]
    assert people["evt-5"] == ["Iris"]
    assert people["evt-6"] == ["Iris Novak", "Tomek"]


def test_dedupe_keeps_the_primary_copy(spark):
    rows = load(spark, [raw(1, "Dinner "), raw(2, "dinner"), raw(3, "Dinner", start="2024-01-01T20:00:00+01:00")])
    rows = rows.withColumn("startDate", F.when(F.col("id") == "evt-3", "2024-01-01T20:00:00+01:00").otherwise(F.col("startDate")))
    ranked = rows.withColumn("priority", F.when(F.col("id") == "evt-2", 0).otherwise(1))
    assert {row.id for row in dedupe.dedupe_events(ranked).collect()} == {"evt-2", "evt-3"}
    assert {row.id for row in dedupe.dedupe_events(ranked, by_instant=True).collect()} == {"evt-2"}


def sources(spark):
    return spark.createDataFrame(
        [("a", "A", "google", "ics_url", "u", True), ("b", "B", "apple", "ics_file", None, None)],
        "source_id string, name string, provider string, kind string, url string, visible boolean",
    )


def test_source_life_cycle(spark):
    requests = spark.createDataFrame(
        [("c", "C", "outlook", "ics_url", "u", False), ("d", "D", "fax", "ics_url", "u", False), ("e", "E", "apple", "ics_file", None, False)],
        "source_id string, name string, provider string, kind string, url string, has_file boolean",
    )
    errors = {row.source_id: row.error for row in manifest.check_sources(requests).collect()}
    assert errors == {"c": None, "d": "unknown provider", "e": "file is required"}
    now = F.lit(dt.datetime(2024, 1, 1))
    added = manifest.register_sources(sources(spark), requests, now)
    assert {row.source_id for row in added.collect()} == {"a", "b", "c"}
    hidden = manifest.set_visibility(added, spark.createDataFrame([("a", False)], "source_id string, visible boolean"))
    assert {row.source_id: row.visible for row in hidden.collect()} == {"a": False, "b": None, "c": True}
    left = manifest.remove_sources(hidden, spark.createDataFrame([("c",)], "source_id string"))
    assert {row.source_id for row in left.collect()} == {"a", "b"}
    events = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b")], "id string, source_id string")
    assert {row.id for row in manifest.merged_source_events(left, events).collect()} == {"2", "3"}


def test_combine_prefers_the_primary_export(spark):
    primary = load(spark, [raw(1, "Dinner"), raw(2, "Walk")])
    imported = load(spark, [raw(0, "DINNER"), raw(7, "Hidden"), raw(8, "Extra")]).withColumn(
        "source_id", F.when(F.col("title") == "Hidden", "h").otherwise("b")
    )
    known = spark.createDataFrame([("h", False), ("b", None)], "source_id string, visible boolean")
    assert {row.title for row in manifest.combine(primary, imported, known).collect()} == {"Dinner", "Walk", "Extra"}


def test_geo_json_and_overrides(spark, tmp_path):
    path = tmp_path / "geo.json"
    path.write_text(json.dumps({"Nopa": {"lat": 1.0, "lon": 2.0, "city": "SF"}, "Lost": None, "Pier": {"lat": 5, "lon": 6}}))
    cached = geo.read_geo(spark, str(path), "json")
    fixes = spark.createDataFrame([("Nopa", 9.0, 8.0), ("Pier", None, 1.0), ("New", 3.0, 4.0)], "location string, lat double, lon double")
    merged = {row.location: (row.lat, row.city) for row in geo.effective_geo(cached, fixes).collect()}
    assert merged == {"Nopa": (9.0, None), "Lost": (None, None), "Pier": (5.0, None), "New": (3.0, None)}
    assert [row.error for row in geo.rejected_overrides(fixes).collect()] == ["override needs numeric lat and lon"]
    assert geo.geocoded_count(cached).first().n_geocoded == 2


def test_records_sink(spark, tmp_path):
    table = spark.createDataFrame(
        [(dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 1, 7), float("nan"), ["a"], 1)],
        "at timestamp_ntz, week date, x double, tags array<string>, n int",
    )
    records.write_records(table, str(tmp_path / "out"))
    [line] = [line for part in (tmp_path / "out").glob("part*") for line in part.read_text().splitlines()]
    assert json.loads(line) == {"at": "2024-01-02T03:04:05Z", "week": "2024-01-07T00:00:00Z", "x": None, "tags": ["a"], "n": 1}


def test_filters(spark):
    events = spark.createDataFrame(
        [
            (1, dt.datetime(2024, 1, 1), "Work", False, " "),
            (2, dt.datetime(2024, 1, 31, 23), "gym", False, "X"),
            (3, dt.datetime(2024, 2, 1), None, True, None),
        ],
        "id int, start timestamp_ntz, category string, is_all_day boolean, location string",
    )

    def ids(df):
        return [row.id for row in df.orderBy("id").collect()]

    assert ids(filters.in_date_range(events, dt.date(2024, 1, 1), dt.date(2024, 1, 31))) == [1, 2]
    assert ids(filters.exclude_categories(events, ["WORK", ""])) == [2, 3]
    assert ids(filters.in_category(events, "GYM")) == [2]
    assert ids(filters.not_in_category(events, "GYM")) == [1, 3]
    assert ids(filters.timed_events(events)) == [1, 2]
    assert ids(filters.located_events(events)) == [2]
