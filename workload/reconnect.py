from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from datelore.functions.timebins import naive
from datelore.operators import filters, reconnect
from datelore.operators import regions as rg
from datelore.sources import tables as t
from workload.registry import query
from workload.sql import CAL, GEO, joined, r, ts

AS_OF = dt.datetime(2001, 7, 1)
KEYS = ["owner_id"]
_NOW = "TIMESTAMP '2001-07-01'"


def as_of():
    return naive(AS_OF)


def calendar(spark, folder):
    return t.order_calendar(spark, folder, people=True)


def metros(spark, folder):
    past = filters.history(t.order_calendar(spark, folder), as_of())
    return rg.metro_map(past, t.order_geo(spark, folder), KEYS)


# Per calendar (a nation) every geocoded place is in one metro, named after its most frequent city.
BASE = f"""{CAL}, {GEO}, past AS (SELECT * FROM cal WHERE "start" <= {_NOW}), pex AS (SELECT * FROM ex WHERE "start" <= {_NOW}),
    pv AS (SELECT owner_id, p.location, city, country, count(*) AS visits FROM past p JOIN geo g ON g.location = p.location GROUP BY ALL),
    lab AS (SELECT owner_id, city || ', ' || country AS region FROM (SELECT owner_id, city, country, row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, sum(visits) DESC, city) AS k
      FROM pv GROUP BY owner_id, city, country) WHERE k = 1),
    loc AS (SELECT pv.owner_id, pv.location, region FROM pv JOIN lab USING (owner_id)),
    usual AS (SELECT owner_id, person, region FROM (SELECT owner_id, person, region, row_number() OVER (PARTITION BY owner_id, person ORDER BY count(*) DESC, region) AS k
      FROM pex JOIN loc USING (owner_id, location) GROUP BY owner_id, person, region) WHERE k = 1),
    seen AS (SELECT owner_id, person, date_diff('microsecond', max("start"), {_NOW}) / 86400000000.0 AS days FROM pex GROUP BY ALL),
    met AS (SELECT DISTINCT owner_id, person, category FROM pex),
    up AS (SELECT * FROM timed WHERE "start" > {_NOW} AND "start" <= {_NOW} + INTERVAL 14 DAY AND location IS NOT NULL)"""


@query("upcoming_events", f"""WITH {BASE} SELECT owner_id, id, title, {ts('"start"')} AS "start", location FROM up""")
def upcoming_events(spark, folder):
    return filters.upcoming_events(t.order_calendar(spark, folder), as_of()).select("owner_id", "id", "title", "start", "location")


@query("usual_region", f"WITH {BASE} SELECT owner_id, person, region FROM usual")
def usual_region(spark, folder):
    past = filters.history(calendar(spark, folder), as_of())
    places = past.filter(F.col("location").isNotNull())
    found = reconnect.location_regions(places, metros(spark, folder), KEYS)
    return reconnect.usual_region(past, found, KEYS)


_CANDIDATE = f"""up.owner_id, up.id AS event_id, up.title AS event_title, up.category AS event_category, {ts('up."start"')} AS event_start, up.location AS event_location"""


@query(
    "reconnect_candidates",
    f"""WITH {BASE} SELECT {_CANDIDATE}, loc.region, met.person, {r('days')} AS days_since_seen
    FROM up LEFT JOIN loc ON loc.owner_id = up.owner_id AND loc.location = up.location
    JOIN met ON met.owner_id = up.owner_id AND met.category = up.category JOIN seen ON seen.owner_id = met.owner_id AND seen.person = met.person
    LEFT JOIN usual ON usual.owner_id = met.owner_id AND usual.person = met.person
    WHERE days <= 365 AND NOT list_contains(up.people, met.person) AND (loc.region IS NULL OR loc.region = usual.region)""",
)
def reconnect_candidates(spark, folder):
    return reconnect.invite_candidates(
        calendar(spark, folder), as_of(), metros(spark, folder), max_days_since_seen=365, keys=KEYS
    )


@query(
    "reconnect_candidates_category",
    f"""WITH {BASE} SELECT {_CANDIDATE}, CAST(NULL AS VARCHAR) AS region, met.person, {r('days')} AS days_since_seen
    FROM up JOIN met ON met.owner_id = up.owner_id AND met.category = up.category JOIN seen ON seen.owner_id = met.owner_id AND seen.person = met.person
    WHERE days <= 730 AND NOT list_contains(up.people, met.person)""",
)
def reconnect_candidates_category(spark, folder):
    return reconnect.invite_candidates(calendar(spark, folder), as_of(), keys=KEYS)


def served(candidates: str, seed: int) -> str:
    """The picks of every event: five people by draw, those not picked for an earlier event first."""
    return f"""dr AS (SELECT owner_id, event_start, event_id, person, md5('{seed}|' || event_id || '|' || person) AS draw FROM {candidates}),
    li0 AS (SELECT owner_id, event_start, event_id, list(person ORDER BY draw, person) AS people FROM dr GROUP BY ALL),
    li AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY event_start, event_id) AS turn FROM li0),
    sv AS (SELECT owner_id, event_id, turn, people[1:5] AS picks, people[1:5] AS known FROM li WHERE turn = 1
      UNION ALL
      SELECT owner_id, event_id, turn, picks, list_concat(known, list_filter(picks, lambda x: NOT list_contains(known, x))) FROM (
        SELECT l.owner_id, l.event_id, l.turn, s.known, list_concat(list_filter(l.people, lambda x: NOT list_contains(s.known, x)),
          list_filter(l.people, lambda x: list_contains(s.known, x)))[1:5] AS picks
        FROM sv s JOIN li l ON l.owner_id = s.owner_id AND l.turn = s.turn + 1)),
    picked AS (SELECT owner_id, event_id, unnest(picks) AS person FROM sv)"""


_PLACED = f"""cand AS (SELECT {_CANDIDATE}, loc.region, met.person, {r('days')} AS days_since_seen
    FROM up LEFT JOIN loc ON loc.owner_id = up.owner_id AND loc.location = up.location
    JOIN met ON met.owner_id = up.owner_id AND met.category = up.category JOIN seen ON seen.owner_id = met.owner_id AND seen.person = met.person
    LEFT JOIN usual ON usual.owner_id = met.owner_id AND usual.person = met.person
    WHERE days <= 730 AND NOT list_contains(up.people, met.person) AND (loc.region IS NULL OR loc.region = usual.region))"""


@query(
    "reconnect_suggestions",
    f"""WITH RECURSIVE {BASE}, {_PLACED}, {served('cand', 7)}
    SELECT c.owner_id, c.person, c.event_id, c.event_title, c.event_category, c.event_start, c.event_location, c.region, c.days_since_seen
    FROM cand c JOIN picked p ON p.owner_id = c.owner_id AND p.event_id = c.event_id AND p.person = c.person""",
)
def reconnect_suggestions(spark, folder):
    picked = reconnect.invite_suggestions(calendar(spark, folder), as_of(), t.order_geo(spark, folder), seed=7, keys=KEYS)
    return picked.select(
        "owner_id", "person", "event_id", "event_title", "event_category", "event_start", "event_location", "region", "days_since_seen"
    )


@query(
    "suggestions_by_event",
    f"""WITH RECURSIVE {BASE}, {_PLACED}, {served('cand', 7)}
    SELECT c.owner_id, c.event_title, c.event_start, coalesce(c.event_location, c.region) AS event_where, {joined('list_sort(list(c.person))')} AS people
    FROM cand c JOIN picked p ON p.owner_id = c.owner_id AND p.event_id = c.event_id AND p.person = c.person GROUP BY ALL""",
)
def suggestions_by_event(spark, folder):
    picked = reconnect.invite_suggestions(calendar(spark, folder), as_of(), t.order_geo(spark, folder), seed=7, keys=KEYS)
    return reconnect.suggestions_by_event(picked, KEYS)


@query(
    "suggestion_counts",
    f"""WITH {BASE}, c AS (SELECT up.owner_id, up.id, count(*) AS c FROM up JOIN met ON met.owner_id = up.owner_id AND met.category = up.category
      JOIN seen ON seen.owner_id = met.owner_id AND seen.person = met.person WHERE days <= 730 AND NOT list_contains(up.people, met.person) GROUP BY ALL)
    SELECT owner_id, id AS event_id, least(c, 5) AS suggestions FROM c""",
)
def suggestion_counts(spark, folder):
    picked = reconnect.invite_suggestions(calendar(spark, folder), as_of(), seed=3, keys=KEYS)
    return picked.groupBy("owner_id", "event_id").agg(F.count("*").alias("suggestions"))
