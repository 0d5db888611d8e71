"""Time zones of iCalendar files and streaming replacement of sources."""

import datetime as dt
from pathlib import Path
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from datelore.sources import ics, zones
from datelore.streaming import calendars

#: A zone with the rules of Berlin from 1996 on, as calendar programs write it, one with a one-off change, and one of Outlook's kind.
OWN = """BEGIN:VCALENDAR
BEGIN:VTIMEZONE
TZID:Own/Middle
BEGIN:DAYLIGHT
TZOFFSETFROM:+0100
RRULE:FREQ=YEARLY;BYMONTH=3;BYDAY=-1SU
DTSTART:19810329T020000
TZOFFSETTO:+0200
END:DAYLIGHT
BEGIN:STANDARD
TZOFFSETFROM:+0200
RRULE:FREQ=YEARLY;BYMONTH=10;BYDAY=-1SU
DTSTART:19961027T030000
TZOFFSETTO:+0100
END:STANDARD
END:VTIMEZONE
BEGIN:VTIMEZONE
TZID:Moved
BEGIN:STANDARD
DTSTART:20200601T000000
RDATE:20200601T000000,20230601T000000
TZOFFSETFROM:-0330
TZOFFSETTO:-0400
END:STANDARD
END:VTIMEZONE
BEGIN:VTIMEZONE
TZID:Custom Eastern
BEGIN:STANDARD
DTSTART:16011104T020000
RRULE:FREQ=YEARLY;BYDAY=1SU;BYMONTH=11
TZOFFSETFROM:-0400
TZOFFSETTO:-0500
END:STANDARD
BEGIN:DAYLIGHT
DTSTART:16010311T020000
RRULE:FREQ=YEARLY;BYDAY=2SU;BYMONTH=3
TZOFFSETFROM:-0500
TZOFFSETTO:-0400
END:DAYLIGHT
END:VTIMEZONE
"""


def event(uid, start, zone=None):
    head = f'DTSTART;TZID="{zone}":' if zone and " " in zone else f"DTSTART;TZID={zone}:" if zone else "DTSTART:"
    return f"BEGIN:VEVENT\nUID:{uid}\nSUMMARY:{uid}\n{head}{start}\nEND:VEVENT\n"


def read(spark, folder, *texts):
    for i, t in enumerate(texts):
        (folder / f"f{i}.ics").write_text(t)
    return {r["title"]: r["startDate"] for r in ics.read_ics(spark, str(folder), "s", "d").collect()}


def utc(wall, zone):
    return wall.replace(tzinfo=ZoneInfo(zone)).astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_own_rules_agree_with_the_zones_they_describe(spark, tmp_path):
    walls = [dt.datetime(2024, 1, 15, 9), dt.datetime(2024, 7, 15, 9)]
    for day in ((2024, 3, 31), (2024, 10, 27), (2024, 3, 10), (2024, 11, 3), (2007, 3, 25)):
        # Around each change, also the skipped and the repeated hour.
        walls += [dt.datetime(*day) + dt.timedelta(minutes=30 * k) for k in range(0, 9)]
    names = {"Own/Middle": "Europe/Berlin", "Custom Eastern": "America/New_York", "W. Europe Standard Time": "Europe/Berlin", "Asia/Tokyo": "Asia/Tokyo", "/Europe/Paris": "Europe/Paris"}
    events, wanted = [], {}
    for z, real in names.items():
        for k, wall in enumerate(walls):
            events.append(event(f"{z} {k}", wall.strftime("%Y%m%dT%H%M%S"), z))
            wanted[f"{z} {k}"] = utc(wall, real)
    assert read(spark, tmp_path, OWN + "".join(events) + "END:VCALENDAR\n") == wanted


def test_one_off_changes_and_unknown_zones(spark, tmp_path):
    found = read(
        spark,
        tmp_path,
        OWN + event("before", "20200531T120000", "Moved") + event("after", "20200601T120000", "Moved") + event("own", "20200601T120000", "Nowhere") + event("utc", "20200601T120000Z") + event("day", "20200601"),
        # Another file knows nothing of the first one's zones.
        "BEGIN:VCALENDAR\n" + event("other", "20200601T120000", "Moved") + "END:VCALENDAR\n",
        # Zones after the events, and a rule that ends.
        "BEGIN:VCALENDAR\n" + event("ended", "20100701T120000", "Brief") + event("held", "20080701T120000", "Brief") + OWN.replace("Own/Middle", "Brief").replace("BYMONTH=3;BYDAY=-1SU", "BYMONTH=3;BYDAY=-1SU;UNTIL=20090401T000000Z") + "END:VCALENDAR\n",
    )
    assert found["before"] == "2020-05-31T15:30:00Z" and found["after"] == "2020-06-01T16:00:00Z"
    assert {found[k] for k in ("own", "utc", "other")} == {"2020-06-01T12:00:00Z"} and found["day"] == "2020-06-01T00:00:00Z"
    assert found["held"] == "2008-07-01T10:00:00Z" and found["ended"] == "2010-07-01T11:00:00Z"


@pytest.mark.parametrize(
    "rule, first, day",
    [
        ("FREQ=YEARLY;BYMONTH=4;BYDAY=1SU", "19700405", (2021, 4, 4)),
        ("FREQ=YEARLY;BYMONTH=9;BYDAY=-2FR", "19700918", (2021, 9, 17)),
        ("FREQ=YEARLY;BYMONTH=3;BYDAY=SU;BYMONTHDAY=8,9,10,11,12,13,14", "19700308", (2021, 3, 14)),
        ("FREQ=YEARLY;BYMONTH=10;BYMONTHDAY=-1", "19701031", (2021, 10, 31)),
        ("FREQ=YEARLY;BYMONTH=5;BYMONTHDAY=9", "19700509", (2021, 5, 9)),
        ("FREQ=YEARLY", "19700620", (2021, 6, 20)),
    ],
)
def test_yearly_rules(spark, rule, first, day):
    block = f"BEGIN:VTIMEZONE\nTZID:Z\nBEGIN:STANDARD\nDTSTART:{first}T030000\nRRULE:{rule}\nTZOFFSETFROM:+0200\nTZOFFSETTO:+0100\nEND:STANDARD\nEND:VTIMEZONE"
    blocks = spark.createDataFrame([("f", block, 2021, 2021)], "file string, zone_block string, first_year int, last_year int")
    walls = [r["wall"] for r in zones.zone_transitions(blocks).filter(F.year("wall") == 2021).collect()]
    assert walls == [dt.datetime(*day, 3)]


def test_windows_names_stand_for_known_zones():
    known = set(zones.zone_names())
    assert not [z for z in zones.WINDOWS.values() if z not in known]


def version(folder, source, number, *events, text=None):
    path = Path(folder) / source / f"v{number}"
    path.mkdir(parents=True)
    (path / "all.ics").write_text(text if text is not None else "BEGIN:VCALENDAR\n" + "".join(events) + "END:VCALENDAR\n")


def test_versions_replace_each_other(spark, tmp_path):
    folder, table, state = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "state")

    def land():
        calendars.land_ics(calendars.stream_ics(spark, folder), table, state).awaitTermination()
        log = {(r["source_id"], r["version"]): (r["event_count"], r["added"], r["changed"], r["removed"], r["last_sync_error"]) for r in calendars.sync_log(spark, table).collect()}
        return sorted(r["id"] for r in calendars.landed_ics(spark, table).collect()), log

    version(folder, "a", 1, event("1", "20200101T100000Z"), event("2", "20200101T110000Z"))
    version(folder, "b c", 1, event("1", "20200101T100000Z"))
    ids, log = land()
    assert ids == ["a:1", "a:2", "b c:1"] and log == {("a", "v1"): (2, 2, 0, 0, None), ("b c", "v1"): (1, 1, 0, 0, None)}
    version(folder, "a", 2, event("2", "20200101T120000Z"), event("3", "20200101T110000Z"))
    ids, log = land()
    assert ids == ["a:2", "a:3", "b c:1"] and log["a", "v2"] == (2, 1, 1, 1, None)
    version(folder, "a", 3, text="not a calendar")
    version(folder, "b c", 2)
    version(folder, "b c", 3, event("9", "20200101T120000Z"))
    ids, log = land()
    assert ids == ["a:2", "a:3", "b c:9"] and log["a", "v3"] == (None, None, None, None, "no calendar in the file")
    assert log["b c", "v3"] == (1, 1, 0, 1, None) and ("b c", "v2") not in log
    version(folder, "b c", 4)
    assert land()[0] == ["a:2", "a:3"]
    assert land()[0] == ["a:2", "a:3"]  # nothing new


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "table")

    def write(number, text):
        (tmp_path / "in" / "s" / f"v{number}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "s" / f"v{number}" / "x.ics").write_text("BEGIN:VCALENDAR\n" + text + "END:VCALENDAR\n")
        return ics.raw_records(spark.read, str(tmp_path / "in" / "s" / f"v{number}"))

    def run(raw, epoch):
        events, log = calendars.replaced(spark, raw, table, epoch)
        events.write.mode("overwrite").parquet(f"{table}/events/epoch={epoch}")
        log.write.mode("overwrite").parquet(f"{table}/log/epoch={epoch}")
        return [tuple(r) for r in calendars.sync_log(spark, table).orderBy("epoch").collect()]

    run(write(1, event("1", "20200101T100000Z")), 0)
    second = write(2, event("1", "20200101T100000Z") + event("2", "20200101T100000Z"))
    once = run(second, 1)
    assert run(second, 1) == once and once[1][:7] == ("s", "v2", 2, 1, 0, 0, None)
    # Events of a batch whose log is missing are not there yet.
    calendars.replaced(spark, write(3, ""), table, 2)[0].write.parquet(f"{table}/events/epoch=2")
    assert sorted(r["id"] for r in calendars.landed_ics(spark, table).collect()) == ["s:1", "s:2"]


def test_a_batch_parses_its_files_once(spark, tmp_path, monkeypatch):
    """The log compares the events that were written; events without a UID keep their numbers, and older versions stay out."""
    made = []
    monkeypatch.setattr(calendars, "_logged", lambda spark, events, *rest, _old=calendars._logged: made.append(events.inputFiles()) or _old(spark, events, *rest))
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    bare = "BEGIN:VEVENT\nDTSTART:20200101T100000Z\nEND:VEVENT\n"
    version(folder, "a", 1, bare)
    version(folder, "a", 2, bare, event("7", "20200101T100000Z"), bare)
    calendars.land_ics(calendars.stream_ics(spark, folder), table, str(tmp_path / "state")).awaitTermination()
    assert len(made) == 1 and made[0] and all("/events/epoch=0/" in path for path in made[0])
    assert sorted(r["id"] for r in calendars.landed_ics(spark, table).collect()) == ["a:7", "a:a-0", "a:a-2"]
    assert [(r["version"], r["event_count"], r["added"]) for r in calendars.sync_log(spark, table).collect()] == [("v2", 3, 3)]
