"""One function per dashboard report, each a dict of lazy DataFrames.

All take the event table, already narrowed by :func:`global_filters` where the
caller wants that, and ``keys`` for many calendars at once. A report that needs an
intermediate twice builds it once; callers who collect several tables of one
report may ``persist`` the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.operators import people, places, reconnect, recurring, regions, resolve, time_use, travel, weekly
from datelore.operators.common import limit_per_key
from datelore.sources.geo import geocoded_count

Report = dict[str, DataFrame]


def meta(df: DataFrame, geo: DataFrame, keys: Sequence[str] = ()) -> Report:
    """Bounds, categories, people and colours of the whole table, and how many places have coordinates."""
    geo_keys = [key for key in keys if key in geo.columns]
    return {
        "bounds": time_use.date_bounds(df, keys),
        "categories": time_use.categories_by_events(df, keys),
        "people": time_use.distinct_people(df, keys),
        "category_colors": time_use.category_colors(df, keys),
        "geocoded": geocoded_count(geo, geo_keys),
    }


def summary(df: DataFrame, keys: Sequence[str] = ()) -> Report:
    return {"summary": time_use.summary(df, keys)}


def breaks(df: DataFrame, keys: Sequence[str] = ()) -> Report:
    phases = weekly.category_phases(df, keys=keys)
    return {
        "category_phases": phases,
        "phase_spans": weekly.phase_spans(phases, keys),
        "quiet_stretches": weekly.quiet_stretches(df, keys=keys),
        "location_shifts": travel.location_shifts(df, keys=keys),
    }


def top_places(df: DataFrame, limit: int = 20, keys: Sequence[str] = ()) -> Report:
    order = [F.col("visits").desc(), F.col("location")]
    return {"places": limit_per_key(places.place_frequency(df, keys), keys, order, limit)}


def stopped_going(df: DataFrame, min_visits: int = 3, inactive_months: int = 9, keys: Sequence[str] = ()) -> Report:
    return {"places": places.stopped_going(df, min_visits, inactive_months, keys=keys)}


def place_map(df: DataFrame, geo: DataFrame, keys: Sequence[str] = (), **filters) -> Report:
    """Places on the map, all place names, and totals. Filters: category, person, first_year, last_year."""
    view = places.locations_view(df, geo, keys=keys, **filters)
    return {
        "locations": view.filter("geocoded").drop("geocoded"),
        "all_locations": view.select(*keys, "location"),
        "totals": places.locations_totals(view, keys),
    }


def top_people(df: DataFrame, limit: int = 20, keys: Sequence[str] = ()) -> Report:
    order = [F.col("events").desc(), F.col("person")]
    return {"people": limit_per_key(people.social_time_share(df, keys), keys, order, limit)}


def trends(df: DataFrame, keys: Sequence[str] = ()) -> Report:
    return {"trends": people.fading_or_growing(df, keys=keys)}


def social_network(df: DataFrame, limit: int = 40, keys: Sequence[str] = ()) -> Report:
    nodes, edges = people.friend_network(df, limit, keys)
    return {"nodes": nodes, "edges": edges}


def person_trend(df: DataFrame, granularity: str = "year", names: Sequence[str] | None = None, top_n: int = 6, keys: Sequence[str] = ()) -> Report:
    return {"trend": people.trend_of_people(df, granularity, names, top_n, keys)}


def habit(df: DataFrame, category: str, keys: Sequence[str] = ()) -> Report:
    series = weekly.weekly_habit_counts(df, category, keys)
    streaks = weekly.streaks_and_gaps(series, keys)
    return {
        "weekly": series,
        "streaks": streaks,
        "longest": weekly.longest_runs(streaks, keys),
        "consistency": weekly.consistency_by_year(series, keys),
        "correlation": weekly.habit_vs_busyness(df, category, keys),
    }


def recurring_events(df: DataFrame, as_of: Column | None = None, keys: Sequence[str] = ()) -> Report:
    return {"series": recurring.in_report_order(recurring.recurring_series(df, as_of=as_of, keys=keys))}


def reconnect_invites(df: DataFrame, as_of: Column, geo: DataFrame | None = None, keys: Sequence[str] = (), **options) -> Report:
    return {"upcoming_invites": reconnect.invite_suggestions(df, as_of, geo, keys=keys, **options)}


def travel_view(df: DataFrame, geo: DataFrame, keys: Sequence[str] = ()) -> Report:
    placed = regions.labelled_places(df, geo, keys)
    visits = regions.region_totals(placed, keys)
    trips = regions.trips_away_from_home(df, geo, keys=keys, placed=placed)
    return {
        "home_region": regions.home_region(visits, keys),
        "region_visits": visits,
        "region_trips": trips,
        "trips_by_region": travel.trips_by_place(trips, "region", keys),
        "tagged_trips": travel.trip_timeline(df, keys=keys),
    }


def travel_neighborhoods(df: DataFrame, geo: DataFrame, metro: str | None = None, keys: Sequence[str] = ()) -> Report:
    return {"neighborhoods": regions.neighborhoods_for_metro(df, geo, metro, keys)}


def time_and_spend(df: DataFrame, costs: time_use.Costs = time_use.DEFAULT_COST_PER_VISIT, keys: Sequence[str] = ()) -> Report:
    return {"categories": time_use.estimated_spend_by_category(df, costs, keys)}


def seasonality(df: DataFrame, category: str | None = None, keys: Sequence[str] = ()) -> Report:
    return {
        "monthly": time_use.monthly_activity(df, category, keys),
        "seasonal": time_use.seasonal_activity(df, category, keys),
    }


def anomalies(df: DataFrame, z_threshold: float = 2.0, keys: Sequence[str] = ()) -> Report:
    return {
        "weekly": weekly.flagged_weeks(df, z_threshold, keys),
        "anomalies": weekly.anomalous_weeks(df, z_threshold, keys),
        "by_category": weekly.category_anomalies(df, z_threshold, keys=keys),
    }


def geocode_job(df: DataFrame, gazetteer: DataFrame, cached: DataFrame, overrides: DataFrame, keys: Sequence[str] = (), force: bool = False) -> Report:
    """Look up every place of the events that has no coordinates yet; ``geo`` is the table after the run."""
    requested = time_use.distinct_locations(df, keys).join(places.location_categories(df, keys), [*keys, "location"], "left")
    resolved = resolve.resolve_locations(requested, gazetteer, cached, overrides, keys=keys, force=force)
    failed = resolve.failures(resolved, df, keys)
    return {
        "geo": resolve.update_geo(cached, resolved, keys),
        "resolved": resolved,
        "failures": failed,
        "by_reason": resolve.failure_reasons(failed, keys),
        "approximate": resolve.approximate_places(resolved, df, keys),
    }
