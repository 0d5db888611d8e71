import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datelore.operators import people, travel, weekly
from datelore.schema import RAW_EVENT
from datelore.sources import events as ev
from datelore.streaming import jobs


def record(i, title, start, hours=1, category="Work", location=None, people=(), owner="o1"):
    end = start + dt.timedelta(hours=hours)
    stamp = "%Y-%m-%dT%H:%M:%SZ"
    return {
        "id": f"e{i}", "title": title, "notes": None, "location": location, "startDate": start.strftime(stamp),
        "endDate": end.strftime(stamp), "isAllDay": False, "calendarTitle": category, "calendarColorHex": None,
        "attendees": list(people), "isRecurring": False, "url": None, "noteTags": {}, "owner_id": owner,
    }


DAY0 = dt.datetime(2024, 1, 1, 9)


def sample_rows():
    rows = []
    for i in range(60):
        start = DAY0 + dt.timedelta(days=i)
        place = "Rome" if i % 20 < 4 else "Oslo"
        rows.append(record(i, f"Stand {i % 3}", start, 1 + i % 4, people=["Al", "Bo Li"][: 1 + i % 2]))
        if i % 20 < 7:
            rows.append(record(f"t{i}", f"Flight {i}", start + dt.timedelta(hours=3), 2, "Travel", place))
    rows.append(record("last", "Flight home", DAY0 + dt.timedelta(days=90), 1, "Travel", "Home"))
    rows.append(record("later", "Flight home", DAY0 + dt.timedelta(days=120), 1, "Travel", "Home"))
    return rows


def write_lines(path, rows):
    path.write_text("\n".join(json.dumps(row) for row in rows))


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    rows = sample_rows()
    for part in range(4):
        write_lines(folder / f"part{part}.json", rows[part::4])
    # A copy of the first file under another name: every row of it is a duplicate.
    (folder / "part9.json").write_text((folder / "part0.json").read_text().replace("Stand", "STAND"))
    return str(folder)


@pytest.fixture(scope="module")
def slightly_late(tmp_path_factory):
    """Files in time order whose rows are up to a few days late."""
    folder = tmp_path_factory.mktemp("late")
    rows = sample_rows()
    for at in range(0, len(rows) - 5, 10):
        rows[at], rows[at + 5] = rows[at + 5], rows[at]
    size = 16
    for part, at in enumerate(range(0, len(rows), size)):
        path = folder / f"part{part}.json"
        write_lines(path, rows[at : at + size])
        os.utime(path, (1_700_000_000 + part, 1_700_000_000 + part))
    return str(folder)


def drain(query):
    query.awaitTermination(120)
    assert not query.isActive


def as_set(df, *columns):
    return {tuple(row) for row in df.select(*columns).collect()}


def run_memory(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    drain(query)
    return df.sparkSession.table(name)


def batch_rows(spark, landing):
    schema = T.StructType([*RAW_EVENT.fields, T.StructField("owner_id", T.StringType())])
    return spark.read.schema(schema).json(landing)


def test_landed_table_equals_batch_ingest(spark, landing, tmp_path):
    rows = jobs.dedupe_stream(jobs.stream_events(spark, landing, ["owner_id"]), "400 days", ["owner_id"])
    drain(jobs.land_events(rows, str(tmp_path / "table"), str(tmp_path / "cp")))
    landed = jobs.landed_events(spark, str(tmp_path / "table"), ["owner_id"])
    raw = batch_rows(spark, landing).withColumn("_t", F.lower("title")).dropDuplicates(["_t", "startDate", "endDate"])
    expected = ev.normalize_events(raw, ["owner_id"])
    assert landed.count() == expected.count() == 83
    assert as_set(landed, "start", "end", "n_people") == as_set(expected, "start", "end", "n_people")


def test_weekly_stream_emits_closed_weeks(spark, landing):
    out = run_memory(jobs.weekly_load_stream(jobs.stream_events(spark, landing, ["owner_id"]), "1 day", ["owner_id"]), "weeks")
    batch = weekly.weekly_load(ev.normalize_events(batch_rows(spark, landing), ["owner_id"]), ["owner_id"])
    closed = batch.filter((F.col("event_count") > 0) & (F.col("week") < F.lit(dt.date(2024, 4, 1))))
    assert as_set(out, "week", "event_count") == as_set(closed, "week", "event_count")


def test_people_stream_matches_batch(spark, landing):
    out = run_memory(jobs.person_frequency_stream(jobs.stream_events(spark, landing, ["owner_id"]), ["owner_id"]), "people", "complete")
    normal = ev.normalize_columns(batch_rows(spark, landing)).withColumn("n_people", F.size("people"))
    batch = people.person_frequency(normal, ["owner_id"])
    assert as_set(out, "person", "events", "last_seen") == as_set(batch, "person", "events", "last_seen")


def test_trip_stream_matches_batch_for_closed_trips(spark, slightly_late):
    rows = jobs.stream_events(spark, slightly_late, ["owner_id"], max_files_per_trigger=1)
    out = run_memory(jobs.trips_stream(rows, ["owner_id"], delay="8 days"), "trips")
    batch = travel.trip_timeline(ev.normalize_events(batch_rows(spark, slightly_late), ["owner_id"]), keys=["owner_id"])
    got = as_set(out, "destination", "start", "end", "n_events")
    want = as_set(batch, "destination", "start", "end", "n_events")
    still_open = {row for row in want if row[2] > dt.datetime(2024, 4, 20)}
    assert len(want) == 8
    assert got == want - still_open


def test_enrich_stream_adds_coordinates(spark, landing):
    geo = spark.createDataFrame([("Rome", 41.9, 12.5)], "location string, lat double, lon double")
    rows = jobs.stream_events(spark, landing, ["owner_id"])
    out = run_memory(jobs.enrich_stream(rows, geo).select("id", "location", "lat"), "placed")
    assert {row.lat for row in out.collect() if row.location == "Rome"} == {41.9}
    assert {row.lat for row in out.collect() if row.location == "Oslo"} == {None}
