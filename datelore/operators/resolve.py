"""Resolve place texts to coordinates with a gazetteer table, as one batch job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.functions import address as ad
from datelore.functions.geo import KM_PER_DEGREE
from datelore.functions.text import none_if_empty
from datelore.operators.common import attach_per_key, reading_all
from datelore.operators.filters import is_complete_address
from datelore.schema import GEO_FIELDS
from datelore.sources.geo import has_coordinates

# --- Fixed values ---
DEFAULT_ANCHORS = {
    "ucla": {"query": "UCLA, Los Angeles, CA", "lat": 34.0689, "lon": -118.4452, "radius_km": 3.0},
    "amgen": {"query": "Amgen, Thousand Oaks, CA", "lat": 34.2064, "lon": -118.8253, "radius_km": 2.0},
}
DEFAULT_ANCHOR_RADIUS_KM = 3.0
NO_MATCH = "no match found for this query"
APPROXIMATE_SUFFIX = " (approximate - couldn't resolve the exact address)"
BIAS_PAD_DEGREES = 3.0
BIAS_MIN_POINTS = 5
# --- end of fixed values ---

Anchors = Mapping[str, str | Mapping]

_ANCHOR_TYPE = "struct<key: string, query: string, lat: double, lon: double, radius_km: double>"


def _anchor_struct(key: str, value) -> Column:
    if isinstance(value, str):
        value = {"query": value}
    radius = value.get("radius_km", DEFAULT_ANCHOR_RADIUS_KM)
    return F.struct(
        F.lit(key).alias("key"),
        F.lit(value.get("query")).cast("string").alias("query"),
        F.lit(value.get("lat")).cast("double").alias("lat"),
        F.lit(value.get("lon")).cast("double").alias("lon"),
        F.lit(float(radius)).alias("radius_km"),
    )


def match_anchor(location: Column, category: Column, anchors: Anchors = DEFAULT_ANCHORS) -> Column:
    """The first anchor whose key occurs in the place or category text.

    Complete addresses need no anchor. Anchors are part of the program, so they
    become one CASE expression and no join.
    """
    chain = F.lit(None).cast(_ANCHOR_TYPE)
    for key, value in reversed(list(anchors.items())):
        word = key.lower()
        hit = F.contains(F.lower(location), F.lit(word)) | F.coalesce(
            F.contains(F.lower(category), F.lit(word)), F.lit(False)
        )
        chain = F.when(hit, _anchor_struct(key, value)).otherwise(chain)
    return F.when(~is_complete_address(location), chain)


def anchor_box(anchor: Column) -> Column:
    """Bounding box of an anchor with coordinates; null for one with text only."""
    pad = anchor["radius_km"] / F.lit(KM_PER_DEGREE)
    return F.when(
        anchor["lat"].isNotNull() & anchor["lon"].isNotNull(),
        F.struct(
            (anchor["lat"] - pad).alias("lat_min"),
            (anchor["lat"] + pad).alias("lat_max"),
            (anchor["lon"] - pad).alias("lon_min"),
            (anchor["lon"] + pad).alias("lon_max"),
        ),
    )


def bias_box(geo: DataFrame, pad_degrees: float = BIAS_PAD_DEGREES, keys: Sequence[str] = ()) -> DataFrame:
    """Padded bounding box of the known points, per calendar; null below five points."""
    pad = F.lit(pad_degrees)
    box = F.struct(
        (F.min("lat") - pad).alias("lat_min"),
        (F.max("lat") + pad).alias("lat_max"),
        (F.min("lon") - pad).alias("lon_min"),
        (F.max("lon") + pad).alias("lon_max"),
    )
    known = geo.filter(has_coordinates())
    return known.groupBy(*keys).agg(F.when(F.count("*") >= BIAS_MIN_POINTS, box).alias("bias_box"))


def inside(box: Column, lat: Column, lon: Column) -> Column:
    return lat.between(box["lat_min"], box["lat_max"]) & lon.between(box["lon_min"], box["lon_max"])


def anchored_query(location: Column, anchor: Column) -> Column:
    """Repaired address text, followed by the anchor's context when there is one."""
    return F.concat_ws(", ", ad.clean_address(location), none_if_empty(anchor["query"]))


def retry_queries(df: DataFrame, query: str, output: str = "retries") -> DataFrame:
    """Add the ordered list of rewritten queries worth trying after ``query`` fails.

    Each entry is a struct (query, label). The rewrites build on each other: later
    ones start from the shortest form found so far.
    """
    q = F.col(query)
    entry = "struct<query: string, label: string>"

    def option(text: str, label: str) -> Column:
        return F.array(F.struct(F.col(text).alias("query"), F.lit(label).alias("label")))

    nothing = F.array().cast(f"array<{entry}>")

    def is_new(text: str) -> Column:
        tried = F.transform("_list", lambda e: e["query"])
        return F.col(text).isNotNull() & ~F.array_contains(tried, F.col(text))

    def append(step: DataFrame, text: str, label: str, test: Column) -> DataFrame:
        return step.withColumn("_list", F.when(test, F.concat("_list", option(text, label))).otherwise(F.col("_list")))

    step = df.withColumns({"_business": ad.strip_business_name(q), "_list": nothing})
    step = append(step, "_business", ad.LABEL_BUSINESS, F.col("_business").isNotNull())
    step = step.withColumn("_base", F.coalesce("_business", q))

    step = step.withColumn("_unit", ad.strip_unit(F.col("_base")))
    step = step.withColumn("_unit", F.when(F.col("_unit") != q, F.col("_unit")))
    step = append(step, "_unit", ad.LABEL_UNIT, F.col("_unit").isNotNull())
    step = step.withColumns({"_second": ad.strip_business_name(F.col("_unit")), "_base": F.coalesce("_unit", "_base")})
    step = append(step, "_second", ad.LABEL_BUSINESS_AND_UNIT, is_new("_second"))

    step = step.withColumn("_direction", ad.strip_street_direction(F.col("_base")))
    step = step.withColumn("_direction", F.when(is_new("_direction"), F.col("_direction")))
    step = append(step, "_direction", ad.LABEL_DIRECTION, F.col("_direction").isNotNull())
    step = step.withColumns(
        {"_second": ad.strip_business_name(F.col("_direction")), "_base": F.coalesce("_direction", "_base")}
    )
    step = append(step, "_second", ad.LABEL_BUSINESS_AND_DIRECTION, is_new("_second"))

    step = step.withColumn("_named", ad.business_name_and_city(q))
    step = append(step, "_named", ad.LABEL_NAME_AND_CITY, is_new("_named"))
    step = step.withColumn("_city", ad.use_containing_city(F.col("_base")))
    step = append(step, "_city", ad.LABEL_CONTAINING_CITY, F.col("_city").isNotNull() & (F.col("_city") != q))
    return step.select(*df.columns, F.col("_list").alias(output))


def to_resolve(requested: DataFrame, cached: DataFrame, overrides: DataFrame, keys: Sequence[str] = (), force: bool = False) -> DataFrame:
    """Requested places that need a lookup: all but corrected ones, or those without a usable entry."""
    on = [*keys, "location"]
    # A place asked for under several categories is looked up under the smallest, so that a rerun finds the same.
    wanted = requested.filter(F.coalesce("location", F.lit("")) != "").groupBy(*on).agg(F.min("category").alias("category"))
    if force:
        return wanted.join(overrides.select(*on).distinct(), on, "left_anti")
    usable = cached.filter(has_coordinates()).select(*on).unionByName(overrides.filter(has_coordinates()).select(*on))
    return wanted.join(usable.distinct(), on, "left_anti")


def resolve_locations(
    requested: DataFrame,
    gazetteer: DataFrame,
    cached: DataFrame,
    overrides: DataFrame,
    anchors: Anchors = DEFAULT_ANCHORS,
    keys: Sequence[str] = (),
    force: bool = False,
) -> DataFrame:
    """Look up every requested place that needs it.

    ``requested`` has (keys, location, category); ``gazetteer`` has (query, rank and
    the place columns), queries compared without case. Per place the first query
    with a match wins: the anchored address, then for complete addresses the
    rewrites in order. Among matches of one query those inside the box of the
    already known points come first, then the smaller rank; an anchor with
    coordinates admits only matches in its own box and stands in for a place that
    has none. Output: keys, location, place columns, ``status`` (resolved,
    approximate or failed), ``reason`` and ``placed_at``.
    """
    keys = list(keys)
    on = [*keys, "location"]
    open_places = to_resolve(requested, cached, overrides, keys, force).select(*on, "category")
    anchored = open_places.withColumn("_anchor", match_anchor(F.col("location"), F.col("category"), anchors))
    queried = anchored.withColumns({"_query": anchored_query(F.col("location"), F.col("_anchor")), "_complete": is_complete_address(F.col("location"))})

    known = cached.filter(has_coordinates()).select(*on, "lat", "lon")
    fixed = overrides.filter(has_coordinates()).select(*on, "lat", "lon")
    points = known.join(fixed.select(*on), on, "left_anti").unionByName(fixed)
    boxes = bias_box(points, keys=keys)
    place = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in GEO_FIELDS.fields])
    entries = gazetteer.select(F.lower("query").alias("_key"), F.col("rank").alias("_rank"), place.alias("_place"))

    def looked_up(attempts: DataFrame, carried: Sequence[Column]) -> DataFrame:
        """The best match of each place's attempts (_try, _text), with what else is gathered of them."""
        keyed = attempts.withColumn("_key", F.lower("_text"))
        keyed = keyed.join(boxes, keys, "left") if keys else attach_per_key(keyed, boxes, keys)
        met = keyed.join(entries, "_key", "left")
        lat, lon = F.col("_place")["lat"], F.col("_place")["lon"]
        bounds = anchor_box(F.col("_anchor"))
        counts = F.col("_place").isNotNull() & (bounds.isNull() | inside(bounds, lat, lon))
        outside = F.when(bounds.isNotNull() | F.col("bias_box").isNull() | inside(F.col("bias_box"), lat, lon), 0).otherwise(1)
        best = F.min_by("_place", F.when(counts, F.struct("_try", outside, "_rank", "_place")))
        return met.groupBy(*on).agg(best.alias("_place"), *carried)

    # Most places match at once; only the rest is worth rewriting. Both read one aggregate, so what tells them apart is part of it.
    first = queried.select(*on, "_anchor", "_query", "_complete", F.lit(0).alias("_try"), F.col("_query").alias("_text"))
    tried = reading_all(looked_up(first, [F.first(c).alias(c) for c in ("_anchor", "_query", "_complete")]))
    rewritable = F.col("_place").isNull() & F.col("_complete")
    listed = retry_queries(tried.filter(rewritable).select(*on, "_query"), "_query", "_retries")
    # An attempt moves with its own text only: the first also has the query, and the list is put together again from its entries.
    # Complete addresses have no anchor.
    option, no_anchor = F.col("_option"), F.lit(None).cast(_ANCHOR_TYPE)
    again = listed.select(*on, "_query", F.posexplode_outer("_retries").alias("_try", "_option"))
    again = again.withColumns({"_query": F.when(F.coalesce("_try", F.lit(0)) == 0, F.col("_query")), "_text": option["query"], "_anchor": no_anchor})
    entry = F.when(option.isNotNull(), F.struct("_try", "_option"))
    in_order = F.transform(F.array_sort(F.collect_set(entry)), lambda e: e["_option"])
    again = looked_up(again, [F.max("_query").alias("_query"), in_order.alias("_retries")]).withColumn("_anchor", no_anchor)
    settled = tried.filter(~rewritable).drop("_complete").withColumn("_retries", F.array().cast(again.schema["_retries"].dataType))
    joined = settled.unionByName(again)
    anchor = F.col("_anchor")
    has_anchor = anchor["lat"].isNotNull() & anchor["lon"].isNotNull()
    label = F.coalesce(none_if_empty(anchor["query"]), F.col("location"))
    values = {
        "lat": anchor["lat"],
        "lon": anchor["lon"],
        "display_name": F.concat(label, F.lit(APPROXIMATE_SUFFIX)),
        "place_type": F.lit("unknown"),
    }
    stand_in = F.struct(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in GEO_FIELDS.fields]
    )
    status = (
        F.when(F.col("_place").isNotNull(), "resolved").when(has_anchor, "approximate").otherwise("failed")
    )
    return joined.select(
        *on,
        F.coalesce("_place", F.when(has_anchor, stand_in)).alias("_entry"),
        status.alias("status"),
        F.when(status == "failed", failure_note(F.col("location"), F.col("_query"), F.col("_retries"))).alias("reason"),
        F.when(status == "approximate", label).alias("placed_at"),
    ).select(*on, "_entry.*", "status", "reason", "placed_at")


def failure_note(location: Column, query: Column, retries: Column) -> Column:
    """Why a place failed, with every query that was tried."""
    quoted = F.concat(F.lit(f'{NO_MATCH} (query: "'), query, F.lit('")'))
    head = F.when(query != location, quoted).otherwise(F.lit(NO_MATCH))
    tried = F.transform(
        retries, lambda e: F.concat(F.lit("also tried "), e["label"], F.lit(' ("'), e["query"], F.lit(f'"): {NO_MATCH}'))
    )
    return F.concat_ws("; ", F.concat(F.array(head), tried))


def update_geo(cached: DataFrame, resolved: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The cache after a run: looked-up places replace their old entry, failures keep null coordinates."""
    on = [*keys, "location"]
    fresh = resolved.select(*on, *[f.name for f in GEO_FIELDS.fields])
    return cached.join(resolved.select(*on), on, "left_anti").unionByName(fresh, allowMissingColumns=True)


def failures(resolved: DataFrame, current: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Failed places that are still in the data, with their reason."""
    on = [*keys, "location"]
    failed = resolved.filter(F.col("reason").isNotNull()).select(*on, "reason")
    return failed.join(current.filter(F.col("location").isNotNull()).select(*on), on, "left_semi")


def failure_reasons(failed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Failed places per reason, without the query text."""
    short = F.substring_index("reason", " (query:", 1)
    return failed.groupBy(*keys, short.alias("reason")).agg(F.count("*").alias("places"))


def approximate_places(resolved: DataFrame, current: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    on = [*keys, "location"]
    placed = resolved.filter(F.col("placed_at").isNotNull()).select(*on, "placed_at")
    return placed.join(current.filter(F.col("location").isNotNull()).select(*on), on, "left_semi")
