from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from datelore.functions.timebins import naive
from datelore.operators import linking, recurring, regions, travel
from datelore.plans import ordering
from datelore.sources import tables as t
from workload.registry import ORACLES, query
from workload.sql import CAL, EVT, GEO, day, n, r, ts

TRAVEL = ["1-urgent", "5-low"]

# Sequential rule: an event joins the stay of the event before it when the place is the
# same and it starts within the gap after the latest end of that island.
STAYS = """mv AS (SELECT *, CASE WHEN lag(place) OVER o IS NOT DISTINCT FROM place AND lag(id) OVER o IS NOT NULL THEN 0 ELSE 1 END AS ch
      FROM {src} WINDOW o AS ({by} ORDER BY "start", id)),
    isl AS (SELECT *, sum(ch) OVER ({by} ORDER BY "start", id ROWS UNBOUNDED PRECEDING) AS island FROM mv),
    brk AS (SELECT *, CASE WHEN "start" - max("end") OVER (PARTITION BY {k}island ORDER BY "start", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      > INTERVAL {gap} DAY THEN 1 ELSE 0 END AS br FROM isl),
    num AS (SELECT *, sum(br) OVER (PARTITION BY {k}island ORDER BY "start", id ROWS UNBOUNDED PRECEDING) AS stay FROM brk),
    stays AS (SELECT {k}any_value(place) AS place, min("start") AS "start", max("end") AS "end", count(*) AS n_events FROM num GROUP BY {k}island, stay)"""


def _stays(src: str, gap: int, keyed: bool) -> str:
    return STAYS.format(src=src, gap=gap, k="owner_id, " if keyed else "", by="PARTITION BY owner_id" if keyed else "")


STAY_COLUMNS = f"""{ts('"start"')} AS "start", {ts('"end"')} AS "end", n_events,
    {r("date_diff('microsecond', " + chr(34) + "start" + chr(34) + ", " + chr(34) + "end" + chr(34) + ") / 86400000000.0")} AS duration_days"""
_TRAVEL = "trav AS (SELECT *, coalesce(location, title) AS place FROM {src} WHERE lower(category) IN ('1-urgent', '5-low'))"


@query(
    "trip_timeline",
    f"WITH {CAL}, {_TRAVEL.format(src='cal')}, {_stays('trav', 3, True)} SELECT owner_id, place AS destination, {STAY_COLUMNS} FROM stays",
)
def trip_timeline(spark, folder):
    return travel.trip_timeline(t.order_calendar(spark, folder), TRAVEL, keys=["owner_id"])


_CLICKS = "trav AS (SELECT *, coalesce(location, title) AS place FROM evt WHERE lower(category) IN ('click', 'view'))"


@query(
    "trip_timeline_single",
    f"WITH {EVT}, {_CLICKS}, {_stays('trav', 3, False)} SELECT place AS destination, {STAY_COLUMNS} FROM stays",
)
def trip_timeline_single(spark, folder):
    return travel.trip_timeline(t.event_calendar(spark, folder), ["Click", "view"])


@query(
    "trip_timeline_users",
    f"WITH {EVT}, {_CLICKS}, {_stays('trav', 1, True)} SELECT owner_id, place AS destination, {STAY_COLUMNS} FROM stays",
)
def trip_timeline_users(spark, folder):
    return travel.trip_timeline(t.event_calendar(spark, folder), ["click", "view"], 1, keys=["owner_id"])


@query(
    "places_visited",
    f"""WITH {CAL}, {_TRAVEL.format(src='cal')}, {_stays('trav', 3, True)}
    SELECT owner_id, place AS destination, count(*) AS trips, {ts('min("start")')} AS first_visit, {ts('max("end")')} AS last_visit,
    {r("sum(date_diff('microsecond', " + chr(34) + "start" + chr(34) + ", " + chr(34) + "end" + chr(34) + ")) / 86400000000.0")} AS total_days FROM stays GROUP BY owner_id, place""",
)
def places_visited(spark, folder):
    return travel.places_visited(t.order_calendar(spark, folder), TRAVEL, keys=["owner_id"])


@query(
    "location_shifts",
    f"""WITH {CAL}, c AS (SELECT owner_id, quarter, location, count(*) AS c FROM cal WHERE location IS NOT NULL GROUP BY ALL),
    tops AS (SELECT *, sum(c) OVER (PARTITION BY owner_id, quarter) AS total, row_number() OVER (PARTITION BY owner_id, quarter ORDER BY c DESC, location) AS k FROM c),
    clear AS (SELECT *, lag(location) OVER (PARTITION BY owner_id ORDER BY quarter) AS before FROM tops WHERE k = 1 AND c / total >= 0.2)
    SELECT owner_id, {day('quarter')} AS quarter, location, c AS visits FROM clear WHERE before <> location""",
)
def location_shifts(spark, folder):
    return travel.location_shifts(t.order_calendar(spark, folder), 0.2, keys=["owner_id"])


_RECURRING_AS_OF = dt.datetime(2024, 2, 1)


@query(
    "recurring_series",
    f"""WITH {EVT}, g AS (SELECT owner_id, title, category, date_diff('microsecond', lag("start") OVER (PARTITION BY owner_id, title ORDER BY "start"), "start") AS gap,
      "start" FROM evt),
    s AS (SELECT owner_id, title, min(category) AS category, count(*) AS occurrences, min("start") AS f, max("start") AS l, quantile_cont(gap, 0.5) / 86400000000.0 AS med
      FROM g GROUP BY owner_id, title HAVING count(*) >= 4),
    d AS (SELECT *, date_diff('microsecond', l, TIMESTAMP '2024-02-01') / 86400000000.0 AS since FROM s WHERE med > 0 AND med <= 45)
    SELECT owner_id, title, category, occurrences, {ts('f')} AS first_seen, {ts('l')} AS last_seen,
    CAST(floor(date_diff('microsecond', f, l) / 86400000000.0) AS BIGINT) AS streak_days, {r('med')} AS median_interval_days, {r('since')} AS days_since_last,
    CASE WHEN since / med <= 1.5 THEN 'active' WHEN since / med <= 3 THEN 'slowing down' ELSE 'stopped' END AS status,
    CASE WHEN med <= 2 THEN 'daily' WHEN med <= 9 THEN 'weekly' WHEN med <= 18 THEN 'biweekly' ELSE 'monthly' END AS cadence FROM d""",
)
def recurring_series(spark, folder):
    as_of = naive(_RECURRING_AS_OF)
    return recurring.recurring_series(t.event_calendar(spark, folder), as_of=as_of, keys=["owner_id"])


@query(
    "recurring_series_orders",
    f"""WITH {CAL}, b AS (SELECT *, regexp_replace(title, ' with Sam Lee and Priya$', '') AS bare FROM cal),
    g AS (SELECT *, date_diff('microsecond', lag("start") OVER (PARTITION BY bare ORDER BY "start"), "start") AS gap FROM b),
    m AS (SELECT bare, category FROM (SELECT bare, category, row_number() OVER (PARTITION BY bare ORDER BY count(*) DESC, category) AS k FROM b GROUP BY bare, category) WHERE k = 1),
    s AS (SELECT bare AS title, any_value(m.category) AS category, count(*) AS occurrences, min("start") AS f, max("start") AS l, quantile_cont(gap, 0.5) / 86400000000.0 AS med
      FROM g JOIN m USING (bare) GROUP BY bare HAVING count(*) >= 4),
    d AS (SELECT *, date_diff('microsecond', l, TIMESTAMP '2002-01-01') / 86400000000.0 AS since FROM s WHERE med > 0 AND med <= 45)
    SELECT title, category, occurrences, {ts('f')} AS first_seen, {ts('l')} AS last_seen,
    CAST(floor(date_diff('microsecond', f, l) / 86400000000.0) AS BIGINT) AS streak_days, {r('med')} AS median_interval_days, {r('since')} AS days_since_last,
    CASE WHEN since / med <= 1.5 THEN 'active' WHEN since / med <= 3 THEN 'slowing down' ELSE 'stopped' END AS status,
    CASE WHEN med <= 2 THEN 'daily' WHEN med <= 9 THEN 'weekly' WHEN med <= 18 THEN 'biweekly' ELSE 'monthly' END AS cadence FROM d""",
)
def recurring_series_orders(spark, folder):
    as_of = naive(dt.datetime(2002, 1, 1))
    return recurring.recurring_series(t.order_calendar(spark, folder), as_of=as_of)


@query(
    "recurring_ranked",
    f"""SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY CASE status WHEN 'stopped' THEN 0 WHEN 'slowing down' THEN 1 ELSE 2 END,
      days_since_last DESC, title) AS rank FROM ({ORACLES["recurring_series"]})""",
)
def recurring_ranked(spark, folder):
    return ordering.numbered("series", recurring_series(spark, folder), ["owner_id"])


@query(
    "ordered_events",
    f"""WITH {CAL} SELECT owner_id, id, title, {ts('"start"')} AS "start", row_number() OVER (PARTITION BY owner_id ORDER BY "start", id) AS rank FROM cal""",
)
def ordered_events(spark, folder):
    events = t.order_calendar(spark, folder).select("owner_id", "id", "title", "start")
    return ordering.numbered("events", events, ["owner_id"])


@query(
    "recurring_ranked_all",
    f"""SELECT *, row_number() OVER (ORDER BY CASE status WHEN 'stopped' THEN 0 WHEN 'slowing down' THEN 1 ELSE 2 END,
      days_since_last DESC, title, category) AS rank FROM ({ORACLES["recurring_series_orders"]})""",
)
def recurring_ranked_all(spark, folder):
    """One calendar of all orders, numbered without keys."""
    return ordering.numbered("series", recurring_series_orders(spark, folder), [])


# The places of one nation lie within the radius and nations lie apart, so the nation is the metro.
METRO = f"""{CAL}, {GEO}, pv AS (SELECT c.location, count(*) AS visits, sum(duration_hours) AS h, min("start") AS f, max("start") AS l,
      any_value(nation) AS nation, any_value(city) AS city, any_value(country) AS country, any_value(neighbourhood) AS neighbourhood
      FROM cal c JOIN geo g ON c.location = g.location GROUP BY c.location),
    lab AS (SELECT nation, metro FROM (SELECT nation, city || ', ' || country AS metro,
      row_number() OVER (PARTITION BY nation ORDER BY count(*) DESC, sum(visits) DESC, city) AS k FROM pv GROUP BY nation, city, country) WHERE k = 1),
    mm AS (SELECT pv.*, metro FROM pv JOIN lab USING (nation))"""
_REGION = """rg AS (SELECT metro AS region, sum(visits) AS visits, sum(h) AS h, min(f) AS f, max(l) AS l, count(*) AS n_locations FROM mm GROUP BY metro)"""


@query("metro_map", f"WITH {METRO} SELECT location, metro FROM mm")
def metro_map(spark, folder):
    return regions.metro_map(t.order_calendar(spark, folder), t.order_geo(spark, folder))


# The greedy rule itself: places one by one in rank order, each with the seeds found before it.
_KM = """2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - p.lat) / 2), 2)
      + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2))))"""


@query(
    "metro_overlap",
    f"""WITH RECURSIVE pl AS (SELECT 'C' || c_custkey AS location, count(*) AS visits, 40.0 + (c_custkey * 37 % 1009) / 250.0 AS lat,
      2.0 + (c_custkey * 101 % 1013) / 180.0 AS lon FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey),
    p AS (SELECT *, row_number() OVER (ORDER BY visits DESC, location) AS k FROM pl),
    g AS (SELECT k, location AS seed, [{{'lat': lat, 'lon': lon, 'name': location}}] AS seeds FROM p WHERE k = 1
      UNION ALL
      SELECT k, coalesce(hit, location), CASE WHEN hit IS NULL THEN list_append(seeds, {{'lat': lat, 'lon': lon, 'name': location}}) ELSE seeds END
      FROM (SELECT p.k, p.location, p.lat, p.lon, g.seeds,
              list_filter(g.seeds, lambda s: {_KM} <= 80.0)[1].name AS hit
            FROM g JOIN p ON p.k = g.k + 1))
    SELECT p.location, p.visits, g.seed FROM p JOIN g USING (k)""",
)
def metro_overlap(spark, folder):
    points = regions.place_points(t.customer_calendar(spark, folder), t.customer_geo(spark, folder))
    return regions.cluster_places(points).select("location", "visits", "seed")


@query(
    "visits_by_region",
    f"""WITH {METRO}, {_REGION} SELECT region, {n('visits')} AS visits, {r('h')} AS total_hours, {ts('f')} AS first_seen, {ts('l')} AS last_seen, n_locations FROM rg""",
)
def visits_by_region(spark, folder):
    return regions.visits_by_region(t.order_calendar(spark, folder), t.order_geo(spark, folder))


@query("home_region", f"WITH {METRO}, {_REGION} SELECT region AS home_region FROM rg ORDER BY visits DESC, region LIMIT 1")
def home_region(spark, folder):
    return regions.home_region(visits_by_region(spark, folder))


@query(
    "neighborhoods",
    f"""WITH {METRO}, {_REGION} SELECT coalesce(neighbourhood, city) AS neighborhood, {n('sum(visits)')} AS visits, {r('sum(h)')} AS total_hours,
    count(*) AS n_locations, {ts('max(l)')} AS last_seen FROM mm WHERE metro = (SELECT region FROM rg ORDER BY visits DESC, region LIMIT 1) GROUP BY 1""",
)
def neighborhoods(spark, folder):
    return regions.neighborhoods_for_metro(t.order_calendar(spark, folder), t.order_geo(spark, folder))


_AWAY = f"""WITH {METRO}, {_REGION}, home AS (SELECT region FROM rg ORDER BY visits DESC, region LIMIT 1),
    away AS (SELECT c.*, metro AS place FROM cal c JOIN (SELECT location, metro FROM mm) USING (location) WHERE metro <> (SELECT region FROM home)),
    {_stays('away', 5, False)}"""


@query("trips_away", f"{_AWAY} SELECT place AS region, {STAY_COLUMNS} FROM stays")
def trips_away(spark, folder):
    return regions.trips_away_from_home(t.order_calendar(spark, folder), t.order_geo(spark, folder))


@query("trips_by_region", f"""{_AWAY} SELECT place AS region, count(*) AS trips, {ts('max("end")')} AS last_end FROM stays GROUP BY place""")
def trips_by_region(spark, folder):
    return travel.trips_by_place(trips_away(spark, folder), "region")


@query(
    "nearest_link",
    f"""WITH {EVT}, d AS (SELECT *, people[1] AS partner FROM evt WHERE category = 'purchase'),
    x AS (SELECT people[1] AS person, "start" AS moment, title AS note, id AS xid FROM evt WHERE category = 'click'),
    c AS (SELECT d.id, d.partner, d."start", x.moment, x.note, x.xid, abs(date_diff('microsecond', d."start", x.moment)) AS gap,
      row_number() OVER (PARTITION BY d.id ORDER BY abs(date_diff('microsecond', d."start", x.moment)), CAST(x.xid AS BIGINT)) AS k
      FROM d JOIN x ON lower(x.person) = lower(d.partner) AND x.moment BETWEEN d."start" - INTERVAL 2 HOUR AND d."start" + INTERVAL 2 HOUR)
    SELECT id, partner AS date_partner, {ts('"start"')} AS "start", partner AS external_person, {ts('moment')} AS external_timestamp, note AS external_note,
    {r('gap / 86400000000.0')} AS gap_days FROM c WHERE k = 1""",
)
def nearest_link(spark, folder):
    events = t.event_calendar(spark, folder)
    external = events.filter(F.col("category") == "click").select(
        F.get("people", F.lit(0)).alias("person"), F.col("start").alias("timestamp"), F.col("title").alias("note"), "id"
    )
    linked = linking.link_to_external(
        events, external, ["Purchase"], 2 / 24, order=F.col("id").cast("bigint")
    )
    return linked.select("id", "date_partner", "start", "external_person", "external_timestamp", "external_note", "gap_days")
