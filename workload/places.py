from __future__ import annotations

from datelore.operators import places as op
from datelore.sources import tables as t
from workload.registry import query
from workload.sql import CAL, EVT, GEO, HAVERSINE, joined, n, r, ts

FREQ = """freq AS (SELECT {k}location, count(*) AS visits, min("start") AS first_seen, max("start") AS last_seen,
    sum(duration_hours) AS total_hours, list_sort(list_distinct(list(category))) AS categories
    FROM {src} WHERE location IS NOT NULL AND trim(location) <> '' GROUP BY {k}location)"""
COLUMNS = f"""location, visits, {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen,
    {r('total_hours')} AS total_hours, {joined('categories')} AS categories"""


@query("place_frequency", f"WITH {CAL}, {FREQ.format(k='', src='cal')} SELECT {COLUMNS} FROM freq")
def place_frequency(spark, folder):
    return op.place_frequency(t.order_calendar(spark, folder))


@query("place_frequency_owner", f"WITH {EVT}, {FREQ.format(k='owner_id, ', src='evt')} SELECT owner_id, {COLUMNS} FROM freq")
def place_frequency_owner(spark, folder):
    return op.place_frequency(t.event_calendar(spark, folder), keys=["owner_id"])


@query(
    "stopped_going",
    f"""WITH {EVT}, {FREQ.format(k='owner_id, ', src='evt')}, m AS (SELECT owner_id, max("start") AS as_of FROM evt GROUP BY 1)
    SELECT owner_id, {COLUMNS}, {r("floor(date_diff('microsecond', last_seen, as_of) / 86400000000.0) / 30.44")} AS months_since_last_visit
    FROM freq JOIN m USING (owner_id) WHERE visits >= 2 AND last_seen < as_of - INTERVAL 0 MONTH""",
)
def stopped_going(spark, folder):
    return op.stopped_going(t.event_calendar(spark, folder), 2, 0, keys=["owner_id"])


@query(
    "stopped_going_orders",
    f"""WITH {CAL}, {FREQ.format(k='', src='cal')}, m AS (SELECT max("start") AS as_of FROM cal)
    SELECT {COLUMNS}, {r("floor(date_diff('microsecond', last_seen, as_of) / 86400000000.0) / 30.44")} AS months_since_last_visit
    FROM freq CROSS JOIN m WHERE visits >= 3 AND last_seen < as_of - INTERVAL 1 MONTH""",
)
def stopped_going_orders(spark, folder):
    return op.stopped_going(t.order_calendar(spark, folder), 3, 1)


_RADIUS = """, loc AS (SELECT {k}year, c.location, count(*) AS c, any_value(lat) AS lat, any_value(lon) AS lon
      FROM cal c JOIN geo g ON c.location = g.location GROUP BY {k}year, c.location),
    home AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k}year ORDER BY c DESC, location) AS rk FROM loc) WHERE rk = 1),
    km AS (SELECT {pk}e.year, {hav} AS km FROM cal e JOIN geo g ON e.location = g.location JOIN home h ON h.year = e.year {on})
    SELECT {k}{year} AS year, count(*) AS n_located_events, {p50} AS median_km_from_home,
    {p90} AS p90_km_from_home, {mx} AS max_km_from_home FROM km GROUP BY {k}year"""


def _radius(keyed: bool) -> str:
    return f"WITH {CAL}, {GEO}" + _RADIUS.format(
        k="owner_id, " if keyed else "",
        pk="e.owner_id, " if keyed else "",
        on="AND h.owner_id = e.owner_id" if keyed else "",
        hav=HAVERSINE.format(a="h", b="g"),
        year=n("year"),
        p50=r("quantile_cont(km, 0.5)"),
        p90=r("quantile_cont(km, 0.9)"),
        mx=r("max(km)"),
    )


@query("radius_of_life", _radius(False))
def radius_of_life(spark, folder):
    return op.radius_of_life_by_year(t.order_calendar(spark, folder), t.order_geo(spark, folder))


@query("radius_of_life_owner", _radius(True))
def radius_of_life_owner(spark, folder):
    return op.radius_of_life_by_year(t.order_calendar(spark, folder), t.order_geo(spark, folder), keys=["owner_id"])


_CELL = """CAST(round_even(lat / (25.0 / 111.0), 0) AS BIGINT) || ',' || CAST(round_even(lon / (25.0 / 111.0), 0) AS BIGINT)"""
_VISITS = """v AS (SELECT c.location, count(*) AS visits, any_value(lat) AS lat, any_value(lon) AS lon
    FROM cal c JOIN geo g ON c.location = g.location GROUP BY c.location)"""


@query(
    "neighborhood_clusters",
    f"""WITH {CAL}, {GEO}, {_VISITS} SELECT {_CELL} AS cluster, count(*) AS n_locations, {n('sum(visits)')} AS visits,
    {r('avg(lat)')} AS center_lat, {r('avg(lon)')} AS center_lon FROM v GROUP BY 1""",
)
def neighborhood_clusters(spark, folder):
    return op.neighborhood_clusters(t.order_calendar(spark, folder), t.order_geo(spark, folder), 25.0)


@query("neighborhood_members", f"WITH {CAL}, {GEO}, {_VISITS} SELECT {_CELL} AS cluster, location, visits FROM v")
def neighborhood_members(spark, folder):
    return op.neighborhood_members(t.order_calendar(spark, folder), t.order_geo(spark, folder), 25.0)


_TITLES = """tc AS (SELECT {k}location, title, count(*) AS c FROM {src} WHERE location IS NOT NULL GROUP BY {k}location, title),
    tt AS (SELECT {k}location, array_to_string(list(CASE WHEN c > 1 THEN title || ' (' || c || '×)' ELSE title END ORDER BY rk), '|') AS titles
    FROM (SELECT *, row_number() OVER (PARTITION BY {k}location ORDER BY c DESC, title) AS rk FROM tc) WHERE rk <= 6 GROUP BY {k}location)"""


@query("location_titles", f"WITH {EVT}, {_TITLES.format(k='', src='evt')} SELECT location, titles FROM tt")
def location_titles(spark, folder):
    return op.location_titles(t.event_calendar(spark, folder))


_VIEW = f"""WITH {CAL}, {GEO}, f AS (SELECT * FROM cal WHERE lower(category) = '2-high' AND list_contains(people, 'S3') AND year >= 1996 AND year <= 2000),
    {FREQ.format(k='', src='f')}, {_TITLES.format(k='', src='f')}"""


@query(
    "locations_view",
    f"""{_VIEW} SELECT {COLUMNS}, {r('lat')} AS lat, {r('lon')} AS lon, display_name, coalesce(place_type, 'unknown') AS place_type,
    country, CAST(NULL AS VARCHAR) AS state, coalesce(titles, '') AS titles, lat IS NOT NULL AS geocoded
    FROM freq LEFT JOIN geo USING (location) LEFT JOIN tt USING (location)""",
)
def locations_view(spark, folder):
    events = t.order_calendar(spark, folder, people=True)
    return op.locations_view(events, t.order_geo(spark, folder), "2-High", "S3", 1996, 2000)


@query("locations_totals", f"{_VIEW} SELECT count(*) AS total_places, count(lat) AS geocoded_places FROM freq LEFT JOIN geo USING (location)")
def locations_totals(spark, folder):
    return op.locations_totals(locations_view(spark, folder))


@query(
    "location_categories",
    f"""WITH {EVT}, g AS (SELECT location, category, count(*) AS c FROM evt WHERE location IS NOT NULL GROUP BY ALL)
    SELECT location, category FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY c DESC, category) AS k FROM g) WHERE k = 1""",
)
def location_categories(spark, folder):
    return op.location_categories(t.event_calendar(spark, folder))


@query(
    "densest_cell",
    f"""WITH {CAL}, {GEO}, {_VISITS}, b AS (SELECT *, CAST(floor(lat / 5.0 + 0.5) AS BIGINT) AS lat_bin, CAST(floor(lon / 5.0 + 0.5) AS BIGINT) AS lon_bin FROM v),
    s AS (SELECT lat_bin, lon_bin FROM b GROUP BY 1, 2 ORDER BY sum(visits) DESC, lat_bin, lon_bin LIMIT 1)
    SELECT location, visits, {r('lat')} AS lat, {r('lon')} AS lon, lat_bin, lon_bin FROM b JOIN s USING (lat_bin, lon_bin)""",
)
def densest_cell(spark, folder):
    return op.densest_cell(t.order_calendar(spark, folder), t.order_geo(spark, folder))
