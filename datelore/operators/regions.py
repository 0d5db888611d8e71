"""Metro areas: clusters of nearby places, and the reports that use them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.functions import geo as geo_fn
from datelore.operators.common import attach_per_key
from datelore.operators.sequences import stays
from datelore.session import ensure_checkpoint_dir
from datelore.sources.geo import with_coordinates

# --- Fixed values ---
METRO_RADIUS_KM = 80.0
TRIP_GAP_DAYS = 5
# --- end of fixed values ---

_GEO_LABELS = ("lat", "lon", "display_name", "city", "country", "neighbourhood")


def place_points(df: DataFrame, geo: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Geocoded places of the events with their visits and labels, one row per place."""
    visits = df.filter(F.col("location").isNotNull()).groupBy(*keys, "location").agg(
        F.count("id").alias("visits"),
        F.sum("duration_hours").alias("total_hours"),
        F.min("start").alias("first_seen"),
        F.max("start").alias("last_seen"),
    )
    geo_keys = [key for key in keys if key in geo.columns]
    return with_coordinates(visits, geo, geo_keys, _GEO_LABELS, how="inner")


def _cells_around(radius_km: float, cell_degrees: float) -> Column:
    """Longitude reach in cells at a row's latitude; whole rings near the poles."""
    # The farthest row of cells a point can reach is one radius towards the pole.
    reach = F.least(F.lit(90.0), F.abs(F.col("lat")) + F.lit(radius_km / geo_fn.KM_PER_DEGREE + cell_degrees))
    angle = math.sin(radius_km / (2 * geo_fn.EARTH_RADIUS_KM))
    width = F.when(
        F.cos(F.radians(reach)) > F.lit(angle),
        F.degrees(2 * F.asin(F.lit(angle) / F.cos(F.radians(reach)))),
    ).otherwise(F.lit(180.0))
    ring = int(math.ceil(360.0 / cell_degrees))
    return F.least(F.ceil(width / F.lit(cell_degrees)) + 1, F.lit(ring // 2 + 1)).cast("int")


def cluster_places(points: DataFrame, radius_km: float = METRO_RADIUS_KM, keys: Sequence[str] = ()) -> DataFrame:
    """Place points with the ``seed`` place of their cluster, written once to the checkpoint folder.

    Places are taken by visits (most first, then by name). A place no earlier seed
    reaches within the radius becomes a seed; every other place belongs to the
    earliest seed that reaches it.

    Places fall into grid cells narrow enough that all places of a cell reach each
    other, so a cell holds at most one seed. Each round looks at the best-ranked
    undecided place of every cell only: one that also ranks before the best of
    every cell in reach is surely a seed. Its neighbours are then decided. Work per
    round is linear in the undecided places and no pairs of places are formed. The
    rounds run while the clusters are asked for, because each decides whether
    another is needed; there are as many as the longest chain of places that wait for
    each other.
    """
    keys = list(keys)
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    ring_km = 2 * math.pi * geo_fn.EARTH_RADIUS_KM / 360.0
    # A square of this side has a diagonal below the radius at the equator, and less elsewhere.
    side = radius_km / ring_km / math.sqrt(2.0) * 0.999
    ring = int(math.ceil(360.0 / side))
    rows_reach = int(math.ceil(radius_km / ring_km / side))
    rank = F.struct((-F.col("visits")).alias("v"), F.col("location").alias("l"))
    everything = points.withColumns(
        {
            "rank": rank,
            "cy": F.floor(F.col("lat") / side).cast("int"),
            "cx": F.floor((F.col("lon") + 180.0) / side).cast("int"),
        }
    ).checkpoint(eager=True)
    cell = [*keys, "cy", "cx"]
    open_points = everything.select(*cell, "location", "lat", "lon", "rank")
    seeds = None

    def spread(df: DataFrame) -> DataFrame:
        """Each row once per cell it can reach; the cells are columns cy, cx."""
        reach = _cells_around(radius_km, side)
        dy = F.explode(F.sequence(F.lit(-rows_reach), F.lit(rows_reach))).alias("_dy")
        rows = df.select("*", reach.alias("_rx")).select("*", dy)
        dx = F.explode(F.sequence(-F.col("_rx"), F.col("_rx"))).alias("_dx")
        moved = rows.select("*", dx).withColumns(
            {"cy": F.col("cy") + F.col("_dy"), "cx": F.pmod(F.col("cx") + F.col("_dx"), F.lit(ring))}
        )
        return moved.drop("_rx", "_dy", "_dx")

    while not open_points.isEmpty():
        leaders = open_points.groupBy(*cell).agg(
            F.min_by(F.struct("location", "lat", "lon", "rank"), F.col("rank")).alias("_p")
        ).select(*cell, "_p.*")
        best_nearby = spread(leaders).groupBy(*cell).agg(F.min("rank").alias("_best"))
        found = (
            leaders.join(best_nearby, cell)
            .filter(F.col("rank") == F.col("_best"))
            .drop("_best")
            .checkpoint(eager=True)
        )
        seeds = found if seeds is None else seeds.unionByName(found)
        reachable = spread(found).select(
            *cell, F.struct("lat", "lon").alias("_s")
        ).groupBy(*cell).agg(F.collect_list("_s").alias("_seeds"))
        near = F.exists(
            F.coalesce("_seeds", F.array()),
            lambda s: geo_fn.haversine_km(F.col("lat"), F.col("lon"), s["lat"], s["lon"]) <= radius_km,
        )
        open_points = (
            open_points.join(reachable, cell, "left").filter(~near).drop("_seeds").checkpoint(eager=True)
        )

    if seeds is None:
        return everything.select(*points.columns, F.lit(None).cast("string").alias("seed"))
    # A cell is reached by a bounded number of seeds, because seeds keep the radius apart.
    reachable = spread(seeds).select(*cell, F.struct("rank", "lat", "lon", "location").alias("_s"))
    reachable = reachable.groupBy(*cell).agg(F.collect_list("_s").alias("_seeds"))
    joined = everything.join(reachable, cell)
    hits = F.filter(
        "_seeds", lambda s: geo_fn.haversine_km(F.col("lat"), F.col("lon"), s["lat"], s["lon"]) <= radius_km
    )
    return joined.select(*points.columns, F.array_min(hits)["location"].alias("seed")).checkpoint(eager=True)


def labelled_places(
    df: DataFrame,
    geo: DataFrame,
    keys: Sequence[str] = (),
    radius_km: float = METRO_RADIUS_KM,
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """Geocoded places of the events with their totals, labels and ``metro``.

    A cluster is named after the city label that covers most of its places; ties
    go to the label with more visits, then to the smaller label. The other reports
    of this module start from these rows, one per place, not from the events.
    """
    keys = list(keys)
    clustered = cluster_places(place_points(df, geo, keys), radius_km, keys)
    label = F.coalesce(geo_fn.region_label(F.col("city"), F.col("country"), F.col("display_name")), F.col("location"))
    labelled = clustered.withColumn("_label", label)
    counted = labelled.groupBy(*keys, "seed", "_label").agg(F.count("*").alias("_places"), F.sum("visits").alias("_visits"))
    chosen = counted.groupBy(*keys, "seed").agg(
        F.min_by("_label", F.struct(-F.col("_places"), -F.col("_visits"), "_label")).alias("metro")
    )
    if renames:
        names = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])
        chosen = chosen.withColumn("metro", F.coalesce(F.try_element_at(names, F.col("metro")), "metro"))
    return labelled.drop("_label").join(chosen, [*keys, "seed"])


def metro_map(df: DataFrame, geo: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    """Metro label of every geocoded place in the events: (keys, location, metro)."""
    return labelled_places(df, geo, keys, **options).select(*keys, "location", "metro")


def visits_by_region(df: DataFrame, geo: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    """Visits, hours, range and places of every metro area."""
    return region_totals(labelled_places(df, geo, keys, **options), keys)


def region_totals(placed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Labelled places summed per metro."""
    return placed.groupBy(*keys, F.col("metro").alias("region")).agg(
        F.sum("visits").alias("visits"),
        F.sum("total_hours").alias("total_hours"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.count("*").alias("n_locations"),
    )


def home_region(region_visits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The metro with most visits; ties go to the smaller label."""
    return region_visits.groupBy(*keys).agg(
        F.min_by("region", F.struct(-F.col("visits"), "region")).alias("home_region")
    )


def trips_away_from_home(
    df: DataFrame, geo: DataFrame, gap_days: float = TRIP_GAP_DAYS, keys: Sequence[str] = (), placed: DataFrame | None = None
) -> DataFrame:
    """Consecutive events in one metro other than home, merged into trips."""
    keys = list(keys)
    placed = labelled_places(df, geo, keys) if placed is None else placed
    home = home_region(region_totals(placed, keys), keys)
    places = attach_per_key(placed.select(*keys, "location", F.col("metro").alias("region")), home, keys)
    away = places.filter(F.col("region") != F.col("home_region")).drop("home_region")
    events = df.filter(F.col("location").isNotNull()).select(*keys, "id", "start", "end", "location")
    return stays(events.join(away, [*keys, "location"]), keys, "region", gap_days)


def neighborhoods_for_metro(
    df: DataFrame, geo: DataFrame, metro: str | None = None, keys: Sequence[str] = (), placed: DataFrame | None = None
) -> DataFrame:
    """Visits per neighbourhood inside one metro, by default each calendar's home."""
    keys = list(keys)
    placed = labelled_places(df, geo, keys) if placed is None else placed
    if metro is None:
        home = home_region(region_totals(placed, keys), keys)
        inside = attach_per_key(placed, home, keys).filter(F.col("metro") == F.col("home_region"))
    else:
        inside = placed.filter(F.col("metro") == metro)
    label = geo_fn.neighbourhood_label(F.col("neighbourhood"), F.col("city"), F.col("location"))
    return inside.groupBy(*keys, label.alias("neighborhood")).agg(
        F.sum("visits").alias("visits"),
        F.sum("total_hours").alias("total_hours"),
        F.count("*").alias("n_locations"),
        F.max("last_seen").alias("last_seen"),
    )


def guess_regions(locations: DataFrame, metros: DataFrame, keys: Sequence[str] = (), max_gram: int = 5) -> DataFrame:
    """Metro guessed from a place's text when it names exactly one known city.

    ``locations`` has (keys, location), ``metros`` has (keys, metro). City names are
    found by their first ``max_gram`` characters: the substrings of a place that are as
    long as some city's start are matched by equality, and only the hits are compared
    in full.
    """
    keys = list(keys)
    cities = (
        metros.select(*keys, "metro")
        .distinct()
        .withColumn("_city", F.lower(F.trim(F.regexp_replace("metro", r"(?s),[^,]*\z", ""))))
        .filter(F.col("_city") != "")
        .withColumn("_gram", F.substring("_city", 1, max_gram))
    )
    sizes = cities.agg(F.collect_set(F.length("_gram")).alias("_sizes")).scalar()
    places = locations.select(*keys, "location").distinct().filter(F.col("location") != "")
    lowered = places.select(*keys, "location", F.lower("location").alias("_text")).withColumn("_sizes", sizes)
    starts = lowered.select("*", F.explode(F.sequence(F.lit(1), F.length("_text"))).alias("_at"))
    pieces = starts.select(*keys, "location", "_text", "_at", F.explode("_sizes").alias("_size")).select(
        *keys, "location", "_text", F.substr("_text", F.col("_at"), F.col("_size")).alias("_gram")
    )
    hits = pieces.join(cities, [*keys, "_gram"]).filter(F.contains("_text", F.col("_city")))
    found = hits.groupBy(*keys, "location").agg(F.min("metro").alias("metro"), F.max("metro").alias("_other"))
    return found.filter(F.col("metro") == F.col("_other")).drop("_other")
