"""Ordered, spatial and random operators against plain-Python references, and hand-made cases."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from datelore.operators import linking, people, reconnect, recurring, regions, resolve, time_use, travel, weekly
from datelore.operators.common import weighted_quantiles, with_share
from datelore.operators.sequences import gap_counts, nearest, stays
from datelore.schema import RAW_EVENT
from datelore.sources import events as ev

T0 = dt.datetime(2024, 1, 1)


def ntz(moment):
    return F.lit(moment).cast("timestamp_ntz")


def random_stays(seed, owners=3, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = T0 + dt.timedelta(hours=rng.randrange(24 * 40))
        rows.append((rng.randrange(owners), i, rng.choice(["A", "A", "B", None]), start, start + dt.timedelta(hours=rng.choice([-5, 1, 30, 100]))))
    return rows


def sequential_stays(rows, gap_days):
    """The rule read row by row."""
    out = []
    for owner in sorted({row[0] for row in rows}):
        current = None
        for _, _, place, start, end in sorted((r for r in rows if r[0] == owner), key=lambda r: (r[3], r[1])):
            if current and place == current[0] and start - current[2] <= dt.timedelta(days=gap_days):
                current[2], current[3] = max(current[2], end), current[3] + 1
            else:
                if current:
                    out.append((owner, *current))
                current = [place, start, end, 1]
        out.append((owner, *current))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, gap_days", [(1, 1), (2, 3), (3, 0.25)])
def test_stays_equal_the_sequential_rule(spark, seed, gap_days):
    rows = random_stays(seed)
    df = spark.createDataFrame(rows, "owner int, id int, place string, start timestamp_ntz, end timestamp_ntz")
    got = [tuple(row) for row in stays(df, ["owner"], "place", gap_days).drop("duration_days").collect()]
    assert sorted(got, key=repr) == sequential_stays(rows, gap_days)
    single = [(0, *row[1:]) for row in rows]
    got = [(0, *row) for row in stays(df.drop("owner"), [], "place", gap_days).drop("duration_days").collect()]
    assert sorted(got, key=repr) == sequential_stays(single, gap_days)


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_equals_a_full_scan(spark, seed):
    rng = random.Random(seed)
    lefts = [(rng.randrange(3), i, T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 20))) for i in range(80)]
    rights = [(rng.randrange(3), i, T0 + dt.timedelta(minutes=5 * rng.randrange(12 * 24 * 20))) for i in range(60)]
    lefts += [(g, 1000 + i, ts) for i, (g, _, ts) in enumerate(rights[:10])]
    rights += [(g, 900 - i, ts) for i, (g, _, ts) in enumerate(rights[:5])]
    limit = dt.timedelta(hours=9)
    expected = set()
    for g, i, ts in lefts:
        near = [(abs(ts - other), j) for h, j, other in rights if h == g and abs(ts - other) <= limit]
        if near:
            expected.add((g, i, min(near)[1]))
    left = spark.createDataFrame(lefts, "g int, i int, at timestamp_ntz")
    right = spark.createDataFrame(rights, "g int, j int, seen timestamp_ntz")
    found = nearest(left, right, ["g"], "at", "seen", F.col("j"), 9 / 24)
    assert {(row.g, row.i, row.match.j) for row in found.collect()} == expected


def test_gap_counts_equal_consecutive_differences(spark):
    rows = random_stays(5, n=120)
    df = spark.createDataFrame(rows, "owner int, id int, place string, start timestamp_ntz, end timestamp_ntz")
    expected = {}
    for owner in {row[0] for row in rows}:
        times = sorted(row[3] for row in rows if row[0] == owner)
        for a, b in zip(times, times[1:]):
            key = (owner, int((b - a).total_seconds() * 1e6))
            expected[key] = expected.get(key, 0) + 1
    assert {(row.owner, row.gap_micros): row.n for row in gap_counts(df, ["owner"]).collect()} == expected


def test_weighted_quantiles_interpolate(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([0.1, 2.5, 7.25, 7.5, 900.0, rng.random() * 50]), rng.randrange(1, 5)) for g in range(6) for _ in range(g * 4 + 1)]
    flat = {}
    for g, v, w in rows:
        flat.setdefault(g, []).extend([v] * w)
    merged = spark.createDataFrame(rows, "g int, v double, w int").groupBy("g", "v").agg(F.sum("w").alias("w"))
    out = weighted_quantiles(merged, ["g"], "v", "w", {"p50": 0.5, "p90": 0.9, "p100": 1.0}, F.floor("v"))
    for row in out.collect():
        assert row.p50 == pytest.approx(statistics.median(flat[row.g]))
        assert row.p90 == pytest.approx(float(np.quantile(flat[row.g], 0.9)))
        assert row.p100 == max(flat[row.g])


def brute_clusters(points, radius):
    def km(a, b):
        p1, p2 = math.radians(a[0]), math.radians(b[0])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))

    ranked = sorted(points, key=lambda p: (-p[1], p[0]))
    seeds, member = [], {}
    for name, _, lat, lon in ranked:
        hit = next((s for s in seeds if km(s[1], (lat, lon)) <= radius), None)
        if hit is None:
            seeds.append((name, (lat, lon)))
        member[name] = hit[0] if hit else name
    return member


POINTS = "location string, visits int, lat double, lon double"


def random_points(seed, n, lat, lon):
    rng = random.Random(seed)
    return [(f"p{i:03d}", rng.randrange(1, 6), rng.uniform(*lat), rng.uniform(*lon)) for i in range(n)]


@pytest.mark.parametrize(
    "name, points",
    [
        ("dense", random_points(1, 250, (33, 36), (-120, -116))),
        ("date line", random_points(2, 200, (-2, 2), (-181.5, -178)) + [(f"e{p[0]}", *p[1:]) for p in random_points(3, 100, (-2, 2), (178, 180))]),
        ("pole", random_points(4, 150, (86, 90), (-180, 180))),
        ("chain", [(f"c{i:03d}", 500 - i, 0.0, 0.5 * i) for i in range(25)]),
    ],
)
def test_clusters_equal_the_greedy_rule(spark, name, points):
    points = [(n, v, lat, (lon + 180) % 360 - 180) for n, v, lat, lon in points]
    df = spark.createDataFrame(points, POINTS)
    expected = brute_clusters(points, 80.0)
    assert {row.location: row.seed for row in regions.cluster_places(df).collect()} == expected


def test_calendars_cluster_apart(spark):
    rows = [("big", *p) for p in random_points(7, 90, (40, 42), (0, 3))] + [("small", *p) for p in random_points(8, 30, (40, 42), (0, 3))]
    df = spark.createDataFrame(rows, "owner string, " + POINTS)
    got = {(row.owner, row.location): row.seed for row in regions.cluster_places(df, keys=["owner"]).collect()}
    for owner in ("big", "small"):
        expected = brute_clusters([row[1:] for row in rows if row[0] == owner], 80.0)
        assert {k[1]: v for k, v in got.items() if k[0] == owner} == expected


def record(i, title, start, end=None, people=(), all_day=False, category="Social", location=None):
    stamp = "%Y-%m-%dT%H:%M:%SZ"
    return (
        f"evt-{i}", title, None, location, start.strftime(stamp), (end or start).strftime(stamp), all_day, category, None,
        list(people), False, None, {},
    )


def events(spark, rows):
    return ev.normalize_events(spark.createDataFrame(rows, RAW_EVENT))


def geo_table(spark, rows):
    return spark.createDataFrame(
        rows, "location string, lat double, lon double, display_name string, city string, country string, neighbourhood string"
    )


US = "United States"
METRO = [
    ("Downtown Office", 34.0522, -118.2437, "x", "Los Angeles", US, "Downtown"),
    ("Beach House", 34.0195, -118.4912, "x", "Santa Monica", US, "Santa Monica"),
    ("SD Hotel", 32.7157, -117.1611, "x", "San Diego", US, None),
]
DC = [
    ("Weekly Meetup Spot", 38.7823, -77.0166, "x", "National Harbor", US, None),
    ("Museum", 38.8913, -77.0200, "x", "Washington", US, None),
    ("Friend's Apartment", 38.9072, -77.0369, "x", "Washington", US, None),
    ("Restaurant", 38.9047, -77.0163, "x", "Washington", US, None),
]


def test_nearby_cities_form_one_metro(spark):
    df = events(spark, [record(i, "Work", T0 + dt.timedelta(days=i), location=p) for i, p in enumerate(["Downtown Office"] * 2 + ["Beach House", "SD Hotel", "Nowhere"])])
    geo = geo_table(spark, METRO)
    visits = {row.region: row.visits for row in regions.visits_by_region(df, geo).collect()}
    assert visits == {"Los Angeles, United States": 3, "San Diego, United States": 1}
    renamed = regions.visits_by_region(df, geo, renames={"Los Angeles, United States": "Greater LA"})
    assert {row.region for row in renamed.collect()} == {"Greater LA", "San Diego, United States"}
    hoods = {row.neighborhood: row.visits for row in regions.neighborhoods_for_metro(df, geo).collect()}
    assert hoods == {"Downtown": 2, "Santa Monica": 1}
    assert regions.neighborhoods_for_metro(df, geo, "Nowhere").count() == 0


def test_metro_is_named_after_the_city_with_more_places(spark):
    rows = [record(i, "Meetup", T0 + dt.timedelta(days=i), location="Weekly Meetup Spot") for i in range(5)]
    rows += [record(10 + i, "x", T0 + dt.timedelta(days=40 + i), location=row[0]) for i, row in enumerate(DC[1:])]
    visits = regions.visits_by_region(events(spark, rows), geo_table(spark, DC)).collect()
    assert [(row.region, row.visits, row.n_locations) for row in visits] == [("Washington, United States", 8, 4)]


def test_trips_away_leave_home_out(spark):
    rows = [record(i, "Gym", T0 + dt.timedelta(days=2 * i), location="Downtown Office") for i in range(3)]
    rows += [record(10 + i, "Trip", T0 + dt.timedelta(days=150 + i), location="SD Hotel") for i in range(2)]
    trips = regions.trips_away_from_home(events(spark, rows), geo_table(spark, METRO)).collect()
    assert [(row.region, row.n_events, row.duration_days) for row in trips] == [("San Diego, United States", 2, 1.0)]
    assert regions.trips_away_from_home(events(spark, rows), geo_table(spark, METRO[:0])).count() == 0


def test_guess_region_needs_exactly_one_match(spark):
    metros = spark.createDataFrame([("Los Angeles, United States",), ("Portland, Oregon",), ("Portland, Maine",), ("Rome",)], "metro string")
    places = spark.createDataFrame([("77 Larkspur Ave los angeles, CA",), ("9 Main, Portland",), ("Nowhere",), ("Romeo",), ("",)], "location string")
    got = {row.location: row.metro for row in regions.guess_regions(places, metros).collect()}
    assert got == {"77 Larkspur Ave los angeles, CA": "Los Angeles, United States", "Romeo": "Rome"}


AS_OF = dt.datetime(2024, 8, 1)
WITHIN, BEYOND = AS_OF - dt.timedelta(days=400), AS_OF - dt.timedelta(days=1000)
GEO = [("Cafe A", 34.05, -118.24, "x", "Los Angeles", US, None), ("Cafe B", 37.77, -122.42, "x", "San Francisco", US, None)]


def suggest(spark, rows, geo=True, **more):
    table = geo_table(spark, GEO) if geo else None
    return reconnect.invite_suggestions(events(spark, rows), ntz(AS_OF), table, **more).collect()


def soon(i, title, days=5, **more):
    return record(i, title, AS_OF + dt.timedelta(days=days), **{"location": "Some Venue", **more})


def test_suggestions_need_category_recency_and_absence(spark):
    rows = [
        record(1, "Standup", WITHIN, people=["Priya"], category="Work", location="Office"),
        record(2, "Coffee", WITHIN, people=["Alice"]),
        record(3, "Standup", BEYOND, people=["Old"], category="Work"),
        record(4, "Standup", WITHIN, people=["Guest"], category="Work"),
        soon(5, "Planning", people=["Guest"], category="Work"),
        soon(6, "Far off", days=20, category="Work"),
        soon(7, "No place", location=None, category="Work"),
        soon(8, "All day", all_day=True, category="Work"),
    ]
    [row] = suggest(spark, rows, geo=False)
    assert (row.person, row.event_title, row.days_since_seen) == ("Priya", "Planning", 400.0)
    assert (row.last_event_title, row.last_event_location, row.last_event_date) == ("Standup", "Office", WITHIN)
    assert suggest(spark, rows, geo=False, max_days_since_seen=30) == []


def test_suggestions_match_region_when_known(spark):
    rows = [
        record(1, "Coffee", WITHIN, people=["Alice"], location="Cafe A"),
        record(2, "Coffee", WITHIN, people=["Erin"], location="Cafe B"),
        record(3, "Coffee", WITHIN, people=["Frank"], location="Some Cafe"),
        record(4, "Coffee", WITHIN, people=["Gina"], location="5 Hill St Los Angeles"),
        soon(5, "Dinner", location="Cafe A"),
        soon(6, "Lunch", days=6, location="77 Larkspur Ave Los Angeles, CA"),
    ]
    picked = {(row.event_title, row.person, row.region) for row in suggest(spark, rows)}
    la = "Los Angeles, United States"
    assert picked == {(event, person, la) for event in ("Dinner", "Lunch") for person in ("Alice", "Gina")}


def test_suggestions_spread_over_people(spark):
    names = [f"P{i}" for i in range(6)]
    rows = [record(i, "Coffee", WITHIN, people=[name]) for i, name in enumerate(names)]
    rows += [soon(20 + i, f"Dinner {i}", days=1 + i) for i in range(3)]
    picked = suggest(spark, rows, geo=False, top_n=3, seed=5)
    by_event = {e: {r.person for r in picked if r.event_title == e} for e in ("Dinner 0", "Dinner 1", "Dinner 2")}
    assert [len(by_event[e]) for e in sorted(by_event)] == [3, 3, 3]
    assert by_event["Dinner 0"] | by_event["Dinner 1"] == set(names)
    again = suggest(spark, rows, geo=False, top_n=3, seed=5)
    assert {(r.event_title, r.person) for r in again} == {(r.event_title, r.person) for r in picked}
    draws = [frozenset((r.event_title, r.person) for r in suggest(spark, rows, geo=False, top_n=3, seed=s)) for s in range(6, 10)]
    assert len(set(draws)) > 1


def series(title, first, step_days, count, **more):
    return [(title, first + dt.timedelta(days=step_days * i), more) for i in range(count)]


def test_recurring_series_statuses(spark):
    as_of = dt.datetime(2024, 6, 1)
    plan = (
        series("Book Club with Ann", as_of - dt.timedelta(days=7 * 10), 7, 10)
        + series("Poker", as_of - dt.timedelta(days=14 * 6 + 18), 14, 6)
        + series("Choir", as_of - dt.timedelta(days=300), 7, 8)
        + series("Rare", as_of - dt.timedelta(days=800), 90, 8)
        + series("Same time", as_of, 0, 6)
        + series("Short", as_of - dt.timedelta(days=30), 7, 3)
    )
    rows = [record(i, title, start, category="Fun") for i, (title, start, _) in enumerate(plan)]
    found = {row.title: row for row in recurring.recurring_series(events(spark, rows), as_of=ntz(as_of)).collect()}
    assert {t: r.status for t, r in found.items()} == {"Book Club": "active", "Poker": "slowing down", "Choir": "stopped"}
    assert (found["Poker"].cadence, found["Poker"].median_interval_days, found["Poker"].occurrences) == ("biweekly", 14.0, 6)
    ordered = recurring.in_report_order(recurring.recurring_series(events(spark, rows), as_of=ntz(as_of)))
    assert [row.title for row in ordered.collect()] == ["Choir", "Poker", "Book Club"]


def test_late_arriving_person_is_fitted_from_the_first_own_year(spark):
    rows, i = [], 0
    for year in range(2015, 2027):
        rows.append(record(i := i + 1, "x", dt.datetime(year, 3, 1), people=["Steady"]))
    for year, count in {2022: 1, 2023: 2, 2024: 4}.items():
        for k in range(count):
            rows.append(record(i := i + 1, "x", dt.datetime(year, 4, 1 + k), people=["Late"]))
    got = {row.person: row for row in people.fading_or_growing(events(spark, rows)).collect()}
    expected = np.polyfit(range(2022, 2027), [1, 2, 4, 0, 0], 1)[0]
    assert got["Late"].slope_events_per_year == pytest.approx(expected)
    assert (got["Late"].first_year, got["Late"].last_year, got["Late"].total_events) == (2022, 2026, 7)
    assert got["Steady"].slope_events_per_year == pytest.approx(0.0)


def test_edges_for_pairs_and_triples(spark):
    rows = [
        record(1, "x", T0, people=["Bo", "Al"]),
        record(2, "x", T0, people=["Al", "Bo", "Cy"]),
        record(3, "x", T0, people=["Al", "Bo"], all_day=True),
        record(4, "x", T0, people=["Dee"]),
    ]
    edges = {(r.person_a, r.person_b): r.shared_events for r in people.friend_network_edges(events(spark, rows)).collect()}
    assert edges == {("Al", "Bo"): 2, ("Al", "Cy"): 1, ("Bo", "Cy"): 1}
    nodes, kept = people.friend_network(events(spark, rows), 2)
    assert {row.person for row in nodes.collect()} == {"Al", "Bo"}
    assert [(row.person_a, row.person_b) for row in kept.collect()] == [("Al", "Bo")]


def test_trend_picks(spark):
    rows = [record(1, "x", T0, people=["Al"]), record(2, "x", T0 + dt.timedelta(days=400), people=["Bo"])]
    df = events(spark, rows)
    assert {(r.person, r.period.year, r.events) for r in people.trend_of_people(df).collect()} == {("Al", 2024, 1), ("Al", 2025, 0), ("Bo", 2024, 0), ("Bo", 2025, 1)}
    assert people.trend_of_people(df, people=[]).count() == 0
    assert {r.person for r in people.trend_of_people(df, people=["Al", "Zed"]).collect()} == {"Al"}
    assert sorted(people.person_trend_table(df, ["2024", "2025"]).columns) == ["2024", "2025", "person"]
    with pytest.raises(ValueError):
        people.person_trend(df, "day")


def test_z_scores_on_skewed_weeks(spark):
    hours = [3.0] * 40 + [0.05] * 5 + [45.0]
    rows = [record(i, "x", T0 + dt.timedelta(days=7 * i), T0 + dt.timedelta(days=7 * i, seconds=int(h * 3600))) for i, h in enumerate(hours)]
    labels = [row.label for row in weekly.anomalous_weeks(events(spark, rows)).collect()]
    assert labels.count("packed") == 1 and labels.count("empty") == 5


def test_series_without_variation_or_events(spark):
    flat = events(spark, [record(i, "x", T0 + dt.timedelta(days=7 * i), T0 + dt.timedelta(days=7 * i, hours=1)) for i in range(5)])
    nothing = flat.filter(F.lit(False))
    assert weekly.anomalous_weeks(flat).count() == 0
    assert weekly.quiet_stretches(flat).count() == 0
    assert weekly.habit_vs_busyness(flat, "social").count() <= 1
    for report in (weekly.weekly_load, weekly.anomalous_weeks, weekly.category_phases, people.fading_or_growing, travel.trip_timeline, travel.location_shifts):
        assert report(nothing).count() == 0
    assert time_use.summary(nothing).first().total_events == 0
    assert [row.avg_events_per_month for row in time_use.monthly_activity(nothing).collect()] == [0.0] * 12


def test_phases_merge_spellings_but_count_them_apart(spark):
    rows = [record(i, "x", T0 + dt.timedelta(days=7 * i), category="Gym" if i % 2 else "gym") for i in range(20)]
    rows += [record(100, "x", T0, category="GYM")]
    phases = weekly.category_phases(events(spark, rows))
    assert {(r.category, r.type, r.weeks) for r in phases.collect()} == {("Gym", "active", 20), ("gym", "active", 20)}


def test_quiet_stretch_is_found(spark):
    rows = [record(i, "x", T0 + dt.timedelta(days=7 * i), T0 + dt.timedelta(days=7 * i, hours=10)) for i in range(30) if not 10 <= i < 14]
    [row] = weekly.quiet_stretches(events(spark, rows)).collect()
    assert row.weeks == 4


def test_three_trips_of_three_events(spark):
    rows, i = [], 0
    for month, place in ((2, "Tokyo"), (5, "Rome"), (9, None)):
        for day in range(3):
            rows.append(record(i := i + 1, "Flight to Lima" if place is None else "Day", dt.datetime(2024, month, 1 + day), category="Other" if place is None else "Travel", location=place))
    df = events(spark, rows)
    assert {(r.destination, r.n_events) for r in travel.trip_timeline(df).collect()} == {("Tokyo", 3), ("Rome", 3), ("Flight to Lima", 3)}
    assert {r.destination: r.trips for r in travel.places_visited(df).collect()} == {"Tokyo": 1, "Rome": 1, "Flight to Lima": 1}


def test_location_shift(spark):
    rows = [record(f"{q}-{i}", "x", dt.datetime(2024, 1 + 3 * q, 1 + i), location=p) for q, p in enumerate("AABC") for i in range(4)]
    rows += [record(f"n{i}", "x", dt.datetime(2024, 7, 10 + i), location=f"noise {i}") for i in range(8)]
    shifts = travel.location_shifts(events(spark, rows)).collect()
    assert [(r.quarter, r.location, r.visits) for r in shifts] == [(dt.date(2024, 10, 1), "C", 4)]


def test_link_to_external(spark):
    rows = [record(1, "Dinner", T0, people=["ALEX"], category="First Date"), record(2, "Solo", T0, category="Date"), record(3, "Late", T0 + dt.timedelta(days=30), people=["Alex"], category="date")]
    external = spark.createDataFrame([("alex", "2024-01-03T00:00:00", "near"), ("Alex", "2023-12-20T00:00:00", "far"), ("Bo", "2024-01-01T00:00:00", "other")], "person string, timestamp string, note string")
    [row] = linking.link_to_external(events(spark, rows), external).collect()
    assert (row.id, row.external_note, row.gap_days) == ("evt-1", "near", 2.0)


def test_share_is_null_for_a_zero_total(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "name string, hours double")
    assert [row.share for row in with_share(df, "hours", "share").collect()] == [None, None]


def test_costs_from_a_table_equal_costs_from_a_mapping(spark):
    rows = [record(i, "x", T0, T0 + dt.timedelta(hours=1), category=c) for i, c in enumerate(["Bar", "bar", "Walk"])]
    table = spark.createDataFrame([("BAR", 25.0)], "category string, cost_per_visit double")
    df = events(spark, rows)
    a = {(r.category, r.estimated_spend) for r in time_use.estimated_spend_by_category(df).collect()}
    assert a == {(r.category, r.estimated_spend) for r in time_use.estimated_spend_by_category(df, table).collect()}
    assert a == {("Bar", 25.0), ("bar", 25.0), ("Walk", None)}
    wide = time_use.spend_by_year_table(df, ["Bar", "bar"])
    assert set(wide.columns) == {"year", "Bar", "bar"}


def test_anchor_stands_in_for_an_unknown_room(spark):
    requested = spark.createDataFrame([("Annex 12", "UCLA"), ("Blue Mesa", "Trip"), ("1 Main St, LA, CA 90001", "UCLA")], "location string, category string")
    gazetteer = spark.createDataFrame(
        [("blue mesa", 1, 38.0, -119.0), ("Blue Mesa", 2, 0.0, 0.0)], "query string, rank int, lat double, lon double"
    )
    for name in ("display_name", "city", "country", "neighbourhood", "state", "place_type"):
        gazetteer = gazetteer.withColumn(name, F.lit(None).cast("string"))
    nothing = spark.createDataFrame([], "location string, lat double, lon double")
    out = {row.location: row for row in resolve.resolve_locations(requested, gazetteer, nothing, nothing).collect()}
    room = out["Annex 12"]
    assert (room.status, room.lat, room.placed_at) == ("approximate", 34.0689, "UCLA, Los Angeles, CA")
    assert "approximate" in room.display_name and room.reason is None and room.place_type == "unknown"
    assert (out["Blue Mesa"].status, out["Blue Mesa"].lat) == ("resolved", 38.0)
    assert out["1 Main St, LA, CA 90001"].status == "failed" and "no match" in out["1 Main St, LA, CA 90001"].reason
    cached = resolve.update_geo(nothing, resolve.resolve_locations(requested, gazetteer, nothing, nothing))
    again = resolve.to_resolve(requested, cached, nothing)
    assert {row.location for row in again.collect()} == {"1 Main St, LA, CA 90001"}


def test_rewritten_queries_move_without_their_list(spark):
    """The lookup of rewrites moves each with its own text; reasons still list them in order, once each however many entries match."""
    line = "7 Hills Bakery 12 8th St SE, Unit 733, Van Nuys, CA 91234, United States"
    requested = spark.createDataFrame([(line, "Work"), ("UCLA Annex 3", "Work")], "location string, category string")
    columns = "query string, rank int, lat double, lon double, display_name string, city string, country string, neighbourhood string, state string, place_type string"
    gazetteer = spark.createDataFrame([("elsewhere", k, 1.0, 2.0, None, None, None, None, None, None) for k in range(2)], columns)
    nothing = gazetteer.select(F.lit("x").alias("location"), "lat", "lon").limit(0)
    resolved = resolve.resolve_locations(requested, gazetteer, nothing, nothing)
    out = {row.location: row for row in resolved.collect()}
    tried = resolve.retry_queries(spark.createDataFrame([(line,)], "q string").select(resolve.anchored_query(F.col("q"), resolve.match_anchor(F.col("q"), F.lit(""))).alias("q")), "q").first()
    assert len(tried.retries) > 2
    assert out[line].reason.split("; ")[1:] == [f'also tried {e.label} ("{e.query}"): {resolve.NO_MATCH}' for e in tried.retries]
    assert out["UCLA Annex 3"].status == "approximate"
    # Complete addresses have no anchor, so their rewrites are no part of the places that stand in for others.
    assert "posexplode" not in resolve.approximate_places(resolved, requested)._jdf.queryExecution().optimizedPlan().toString()
    again = resolve.approximate_places(resolved, requested).collect()
    assert [row.location for row in again] == ["UCLA Annex 3"]
