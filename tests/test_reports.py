"""Every report runs on the sample calendar, for one calendar and for many."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from datelore.operators.filters import global_filters
from datelore.plans import reports
from datelore.plans.ordering import first_rows, ordered, ordered_report
from datelore.sources import tables

AS_OF = dt.datetime(2001, 7, 1)


@pytest.fixture(scope="module")
def calendar(spark, sample):
    return tables.order_calendar(spark, sample, people=True).cache()


@pytest.fixture(scope="module")
def geo(spark, sample):
    return tables.order_geo(spark, sample).cache()


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


CASES = {
    "meta": lambda df, geo, keys: reports.meta(df, geo, keys),
    "summary": lambda df, geo, keys: reports.summary(df, keys),
    "breaks": lambda df, geo, keys: reports.breaks(df, keys),
    "top_places": lambda df, geo, keys: reports.top_places(df, 20, keys),
    "stopped_going": lambda df, geo, keys: reports.stopped_going(df, keys=keys),
    "place_map": lambda df, geo, keys: reports.place_map(df, geo, keys, category="2-high", person="S3", first_year=1996, last_year=2000),
    "top_people": lambda df, geo, keys: reports.top_people(df, 20, keys),
    "trends": lambda df, geo, keys: reports.trends(df, keys),
    "social_network": lambda df, geo, keys: reports.social_network(df, 40, keys),
    "person_trend": lambda df, geo, keys: reports.person_trend(df, "month", ["S1", "S2"], keys=keys),
    "habit": lambda df, geo, keys: reports.habit(df, "1-Urgent", keys),
    "recurring_events": lambda df, geo, keys: reports.recurring_events(df, now(), keys),
    "reconnect_invites": lambda df, geo, keys: reports.reconnect_invites(df, now(), geo, keys, seed=1),
    "travel_view": lambda df, geo, keys: reports.travel_view(df, geo, keys),
    "travel_neighborhoods": lambda df, geo, keys: reports.travel_neighborhoods(df, geo, keys=keys),
    "time_and_spend": lambda df, geo, keys: reports.time_and_spend(df, {"1-urgent": 5}, keys),
    "seasonality": lambda df, geo, keys: reports.seasonality(df, "2-HIGH", keys),
    "anomalies": lambda df, geo, keys: reports.anomalies(df, 2.0, keys),
}


# Depends on the data: few owners travel, have a dominant place or a quiet month.
MAY_BE_EMPTY = {
    "category_phases", "location_shifts", "phase_spans", "places", "quiet_stretches", "region_trips", "series",
    "tagged_trips", "trips_by_region", "upcoming_invites",
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("keys", [(), ("owner_id",)])
def test_report(calendar, geo, name, keys):
    narrowed = global_filters(calendar, dt.date(1995, 1, 1), dt.date(2001, 12, 31), ["5-low"])
    for title, table in CASES[name](narrowed, geo, list(keys)).items():
        rows = table.collect()
        assert rows or title in MAY_BE_EMPTY, title
        if keys and not name == "meta":
            assert "owner_id" in table.columns
            assert all(row.owner_id is not None for row in rows)


def test_shares_and_totals_agree(calendar):
    table = reports.top_people(calendar, 10_000)["people"].collect()
    assert sum(row.share_of_social_hours for row in table) == pytest.approx(1.0)
    weeks = reports.anomalies(calendar)["weekly"].orderBy("week").collect()
    assert all(b.week - a.week == dt.timedelta(days=7) for a, b in zip(weeks, weeks[1:]))
    assert sum(row.event_count for row in weeks) == calendar.filter(~F.col("is_all_day")).count()
    totals = {
        g: reports.person_trend(calendar, g, ["S1"])["trend"].agg(F.sum("events")).first()[0] for g in ("year", "month", "week")
    }
    assert len(set(totals.values())) == 1


def test_geocode_job(spark, sample):
    addresses = tables.customer_addresses(spark, sample)
    cached = spark.createDataFrame([], "location string, lat double, lon double")
    job = reports.geocode_job(addresses, tables.gazetteer(spark, sample), cached, cached)
    status = {row.status: row["count"] for row in job["resolved"].groupBy("status").count().collect()}
    assert set(status) == {"resolved", "approximate", "failed"}
    assert job["failures"].count() == status["failed"]
    assert job["geo"].count() == sum(status.values())


def test_display_orders(calendar, geo):
    habit = reports.habit(calendar, "1-urgent")
    weeks = [row.weeks for row in first_rows("streaks", habit["streaks"], 12).collect()]
    assert len(weeks) == 12 and weeks == sorted(weeks, reverse=True)
    spend = ordered("categories", reports.time_and_spend(calendar, {"1-urgent": 5, "2-high": 9})["categories"]).collect()
    assert [row.estimated_spend is None for row in spend] == [False, False, True, True, True]
    assert spend[0].estimated_spend > spend[1].estimated_spend
    for name in CASES:
        report = CASES[name](calendar, geo, [])
        for title, table in ordered_report(report).items():
            assert table.columns == report[title].columns
