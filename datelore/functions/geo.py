"""Distances, grid cells and labels of geocoded places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from datelore.functions.text import none_if_empty, strip

# --- Fixed values ---
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0
PLACE_TYPE_BY_CLASS_AND_TYPE = {
    "place": {"house": "residential", "residential": "residential"},
    "building": {
        "residential": "residential", "apartments": "residential", "house": "residential",
        "houses": "residential", "detached": "residential", "dormitory": "residential",
        "commercial": "commercial", "retail": "commercial", "office": "commercial",
        "industrial": "commercial", "warehouse": "commercial",
        "civic": "public", "public": "public", "school": "public", "hospital": "public", "church": "public",
    },
}
PLACE_TYPE_BY_CLASS = {
    "shop": "commercial", "office": "commercial", "craft": "commercial",
    "leisure": "recreational", "tourism": "recreational", "natural": "recreational",
}
# Amenities that are neither commercial nor recreational count as public.
COMMERCIAL_AMENITIES = [
    "restaurant", "cafe", "bar", "pub", "fast_food", "bank", "pharmacy", "cinema",
    "nightclub", "fuel", "car_wash", "car_rental", "marketplace", "food_court", "ice_cream",
    "casino", "coworking_space",
]
RECREATIONAL_AMENITIES = ["theatre", "arts_centre"]
CITY_FIELDS = ["city", "town", "village", "municipality", "county"]
NEIGHBOURHOOD_FIELDS = ["suburb", "neighbourhood", "quarter", "city_district", "borough"]
# --- end of fixed values ---


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def degree_cell(degrees: Column, cell_degrees: float) -> Column:
    """Index of the nearest multiple of the cell size, ties to the even index."""
    return F.bround(degrees / F.lit(cell_degrees), 0).cast("bigint")


def half_up_cell(degrees: Column, cell_degrees: float) -> Column:
    return F.floor(degrees / F.lit(cell_degrees) + F.lit(0.5)).cast("bigint")


def classify_place(osm_class: Column, osm_type: Column) -> Column:
    exact = F.lit(None).cast("string")
    for klass, types in PLACE_TYPE_BY_CLASS_AND_TYPE.items():
        for label in sorted(set(types.values())):
            names = [name for name, kind in types.items() if kind == label]
            exact = F.coalesce(exact, F.when((osm_class == klass) & osm_type.isin(names), label))
    amenity = (
        F.when(osm_type.isin(COMMERCIAL_AMENITIES), "commercial")
        .when(osm_type.isin(RECREATIONAL_AMENITIES), "recreational")
        .otherwise("public")
    )
    by_class = F.lit(None).cast("string")
    for label in sorted(set(PLACE_TYPE_BY_CLASS.values())):
        names = [name for name, kind in PLACE_TYPE_BY_CLASS.items() if kind == label]
        by_class = F.coalesce(by_class, F.when(osm_class.isin(names), label))
    return F.coalesce(exact, F.when(osm_class == "amenity", amenity), by_class, F.lit("unknown"))


def _first_filled(address: Column, fields) -> Column:
    return F.coalesce(*[none_if_empty(address[field]) for field in fields])


def address_city(address: Column) -> Column:
    """City of a structured address: the first filled of city, town, village and so on."""
    return _first_filled(address, CITY_FIELDS)


def address_neighbourhood(address: Column) -> Column:
    return _first_filled(address, NEIGHBOURHOOD_FIELDS)


def region_from_display_name(display_name: Column) -> Column:
    """ "City, Country" guessed from a full address line."""
    parts = F.filter(F.transform(F.split(display_name, ","), strip), lambda part: part != "")
    size = F.size(parts)
    country = F.get(parts, size - 1)
    # A leading venue segment is skipped when enough parts remain.
    places = F.when(size > 3, F.slice(parts, F.lit(2), F.greatest(size - 2, F.lit(0)))).otherwise(
        F.slice(parts, F.lit(1), F.greatest(size - 1, F.lit(0)))
    )
    city = F.coalesce(F.get(F.filter(places, lambda part: ~part.rlike(r"(?U)\d")), F.lit(0)), F.get(parts, size - 2))
    label = F.when(city != country, F.concat_ws(", ", city, country)).otherwise(country)
    return F.when(none_if_empty(display_name).isNull(), F.lit(None)).when(size < 2, display_name).otherwise(label)


def region_label(city: Column, country: Column, display_name: Column) -> Column:
    city, country = none_if_empty(city), none_if_empty(country)
    return F.coalesce(
        F.when(city.isNotNull() & country.isNotNull(), F.concat_ws(", ", city, country)),
        country,
        region_from_display_name(display_name),
    )


def neighbourhood_label(neighbourhood: Column, city: Column, location: Column) -> Column:
    return F.coalesce(none_if_empty(neighbourhood), none_if_empty(city), location)
