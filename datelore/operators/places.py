"""Reports about places, by their exact text or by coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.functions import geo as geo_fn
from datelore.functions.timebins import whole_days_between
from datelore.operators.common import attach_per_key, mode_per_group, top_n_per_group, weighted_quantiles
from datelore.operators.filters import in_category, in_years, located_events, with_person
from datelore.sources.geo import with_coordinates

# --- Fixed values ---
DAYS_PER_MONTH = 30.44
DENSEST_BIN_DEGREES = 5.0
# --- end of fixed values ---


def place_frequency(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Visits, first and last visit, hours and sorted categories per place."""
    # Counting by category first keeps the wide pass a plain hash aggregate.
    by_category = located_events(df).groupBy(*keys, "location", "category").agg(
        F.count("id").alias("_visits"),
        F.min("start").alias("_first"),
        F.max("start").alias("_last"),
        F.sum("duration_hours").alias("_hours"),
    )
    return by_category.groupBy(*keys, "location").agg(
        F.sum("_visits").alias("visits"),
        F.min("_first").alias("first_seen"),
        F.max("_last").alias("last_seen"),
        F.sum("_hours").alias("total_hours"),
        F.sort_array(F.collect_set("category")).alias("categories"),
    )


def stopped_going(
    df: DataFrame, min_visits: int = 3, inactive_months: int = 9, as_of: Column | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Places with enough visits and none in the last months before ``as_of`` (default: latest event)."""
    places = place_frequency(df, keys)
    if as_of is None:
        places = attach_per_key(places, df.groupBy(*keys).agg(F.max("start").alias("_as_of")), keys)
    else:
        places = places.withColumn("_as_of", as_of)
    cutoff = F.col("_as_of") - F.make_ym_interval(months=F.lit(inactive_months))
    days = whole_days_between(F.col("last_seen"), F.col("_as_of"))
    return (
        places.filter((F.col("visits") >= min_visits) & (F.col("last_seen") < cutoff))
        .withColumn("months_since_last_visit", days / F.lit(DAYS_PER_MONTH))
        .drop("_as_of")
    )


def radius_of_life_by_year(
    df: DataFrame, geo: DataFrame, home: tuple[float, float] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Per year: events with coordinates and median, 90th percentile and longest distance from home.

    Without a given home it is the most visited geocoded place of the year.
    Distances are taken once per place and year and weighted by visits.
    """
    keys = list(keys)
    visits = df.filter(F.col("location").isNotNull()).groupBy(*keys, "year", "location").agg(F.count("*").alias("_n"))
    placed = with_coordinates(visits, geo, _geo_keys(geo, keys), how="inner")
    if home is None:
        homes = placed.groupBy(*keys, "year").agg(
            F.min_by(F.struct("lat", "lon"), F.struct(-F.col("_n"), "location")).alias("_home")
        )
        placed = placed.join(homes, [*keys, "year"])
        lat, lon = F.col("_home")["lat"], F.col("_home")["lon"]
    else:
        lat, lon = F.lit(float(home[0])), F.lit(float(home[1]))
    distances = (
        placed.withColumn("_km", geo_fn.haversine_km(lat, lon, F.col("lat"), F.col("lon")))
        .groupBy(*keys, "year", "_km")
        .agg(F.sum("_n").alias("_n"))
    )
    totals = distances.groupBy(*keys, "year").agg(
        F.sum("_n").alias("n_located_events"), F.max("_km").alias("max_km_from_home")
    )
    quantiles = weighted_quantiles(
        distances,
        [*keys, "year"],
        "_km",
        "_n",
        {"median_km_from_home": 0.5, "p90_km_from_home": 0.9},
        F.floor("_km"),
    )
    return totals.join(quantiles, [*keys, "year"])


def _visits_per_cell(df: DataFrame, geo: DataFrame, grid_km: float, keys: Sequence[str]) -> DataFrame:
    visits = located_events(df).groupBy(*keys, "location").agg(F.count("id").alias("visits"))
    placed = with_coordinates(visits, geo, _geo_keys(geo, keys), how="inner")
    cell = grid_km / geo_fn.KM_PER_DEGREE
    return placed.withColumn(
        "cluster",
        F.concat_ws(
            ",",
            geo_fn.degree_cell(F.col("lat"), cell).cast("string"),
            geo_fn.degree_cell(F.col("lon"), cell).cast("string"),
        ),
    )


def _geo_keys(geo: DataFrame, keys: Sequence[str]) -> list[str]:
    """Keys the place table is kept by; a table without them is shared by all calendars."""
    return [key for key in keys if key in geo.columns]


def neighborhood_clusters(df: DataFrame, geo: DataFrame, grid_km: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Visits and mean centre per grid cell; the member places are in :func:`neighborhood_members`."""
    return _visits_per_cell(df, geo, grid_km, keys).groupBy(*keys, "cluster").agg(
        F.count("*").alias("n_locations"),
        F.sum("visits").alias("visits"),
        F.avg("lat").alias("center_lat"),
        F.avg("lon").alias("center_lon"),
    )


def neighborhood_members(df: DataFrame, geo: DataFrame, grid_km: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """One row per place with its grid cell, so that a dense cell never becomes one huge row."""
    return _visits_per_cell(df, geo, grid_km, keys).select(*keys, "cluster", "location", "visits")


def location_titles(df: DataFrame, top_n: int = 6, keys: Sequence[str] = ()) -> DataFrame:
    """The most frequent titles per place, as a list with "(n×)" after repeated ones."""
    counted = located_events(df).filter(F.col("title").isNotNull())
    counted = counted.groupBy(*keys, "location", "title").agg(F.count("*").alias("_n"))
    top = top_n_per_group(counted, [*keys, "location"], [F.col("_n").desc(), F.col("title")], top_n, "_rank")
    label = F.when(F.col("_n") > 1, F.concat("title", F.lit(" ("), F.col("_n").cast("string"), F.lit("×)")))
    listed = F.sort_array(F.collect_list(F.struct("_rank", F.coalesce(label, "title").alias("label"))))
    return top.groupBy(*keys, "location").agg(F.transform(listed, lambda entry: entry["label"]).alias("titles"))


def locations_view(
    df: DataFrame,
    geo: DataFrame,
    category: str | None = None,
    person: str | None = None,
    first_year: int | None = None,
    last_year: int | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Every visited place with coordinates, labels and titles; ``geocoded`` marks those on the map."""
    events = in_years(with_person(in_category(df, category), person), first_year, last_year)
    fields = ("lat", "lon", "display_name", "place_type", "country", "state")
    placed = with_coordinates(place_frequency(events, keys), geo, _geo_keys(geo, keys), fields)
    titled = placed.join(location_titles(events, keys=keys), [*keys, "location"], "left")
    return titled.withColumns(
        {
            "place_type": F.coalesce(F.nullif("place_type", F.lit("")), F.lit("unknown")),
            "titles": F.coalesce("titles", F.array().cast("array<string>")),
            "geocoded": F.col("lat").isNotNull() & F.col("lon").isNotNull(),
        }
    )


def locations_totals(view: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return view.groupBy(*keys).agg(
        F.count("*").alias("total_places"), F.count_if("geocoded").alias("geocoded_places")
    )


def location_categories(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent category of each place."""
    return mode_per_group(df.filter(F.col("location").isNotNull()), [*keys, "location"], "category")


def densest_cell(df: DataFrame, geo: DataFrame, bin_degrees: float = DENSEST_BIN_DEGREES, keys: Sequence[str] = ()) -> DataFrame:
    """The places inside the coarse cell with most visits."""
    visits = located_events(df).groupBy(*keys, "location").agg(F.count("id").alias("visits"))
    placed = with_coordinates(visits, geo, _geo_keys(geo, keys), how="inner").withColumns(
        {
            "lat_bin": geo_fn.half_up_cell(F.col("lat"), bin_degrees),
            "lon_bin": geo_fn.half_up_cell(F.col("lon"), bin_degrees),
        }
    )
    bins = placed.groupBy(*keys, "lat_bin", "lon_bin").agg(F.sum("visits").alias("_visits"))
    best = bins.groupBy(*keys).agg(
        F.min_by(F.struct("lat_bin", "lon_bin"), F.struct(-F.col("_visits"), "lat_bin", "lon_bin")).alias("_bin")
    )
    inside = (F.col("lat_bin") == F.col("_bin")["lat_bin"]) & (F.col("lon_bin") == F.col("_bin")["lon_bin"])
    return attach_per_key(placed, best, keys).filter(inside).drop("_bin")
