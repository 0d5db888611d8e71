from __future__ import annotations

import datetime as dt

from datelore.functions.timebins import naive
from datelore.operators import people as op
from datelore.sources import tables as t
from workload.registry import query
from workload.sql import CAL, day, n, r, ts

AS_OF = dt.datetime(2001, 8, 2)
AS_OF_SQL = "TIMESTAMP '2001-08-02'"
FREQ = """pf AS (SELECT {k}person, count(*) AS events, sum(duration_hours) AS total_hours, min("start") AS first_seen, max("start") AS last_seen
    FROM ex GROUP BY {k}person)"""
COLUMNS = f"""person, events, {r('total_hours')} AS total_hours, {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen"""


def as_of():
    return naive(AS_OF)


def calendar(spark, folder):
    return t.order_calendar(spark, folder, people=True)


@query("person_frequency", f"WITH {CAL}, {FREQ.format(k='')} SELECT {COLUMNS} FROM pf")
def person_frequency(spark, folder):
    return op.person_frequency(calendar(spark, folder))


@query(
    "social_time_share",
    f"""WITH {CAL}, {FREQ.format(k='owner_id, ')} SELECT owner_id, {COLUMNS},
    {r('total_hours / sum(total_hours) OVER (PARTITION BY owner_id)')} AS share_of_social_hours FROM pf""",
)
def social_time_share(spark, folder):
    return op.social_time_share(calendar(spark, folder), keys=["owner_id"])


@query(
    "top_people",
    f"WITH {CAL}, {FREQ.format(k='')} SELECT {COLUMNS} FROM pf ORDER BY events DESC, person LIMIT 20",
)
def top_people(spark, folder):
    return op.top_people(calendar(spark, folder), 20)


def _trend(period: str, keyed: bool) -> str:
    k = "owner_id, " if keyed else ""
    join = "JOIN" if keyed else "CROSS JOIN"
    using = "USING (owner_id)" if keyed else ""
    return f"""WITH {CAL}, c AS (SELECT {k}person, {period} AS period, count(*) AS c FROM ex GROUP BY ALL)
    SELECT {k}person, {day('period')} AS period, coalesce(c, 0) AS events
    FROM (SELECT DISTINCT {k}person FROM c) p {join} (SELECT DISTINCT {k}period FROM c) q {using} LEFT JOIN c USING ({k}person, period)"""


@query("person_trend_year", _trend("CAST(date_trunc('year', \"start\") AS DATE)", True))
def person_trend_year(spark, folder):
    return op.person_trend(calendar(spark, folder), "year", keys=["owner_id"])


@query("person_trend_month", _trend("CAST(date_trunc('month', \"start\") AS DATE)", False))
def person_trend_month(spark, folder):
    return op.person_trend(calendar(spark, folder), "month")


@query("person_trend_week", _trend("week", True))
def person_trend_week(spark, folder):
    return op.person_trend(calendar(spark, folder), "week", keys=["owner_id"])


@query(
    "person_trend_top",
    f"""WITH {CAL}, {FREQ.format(k='')}, top AS (SELECT person FROM pf ORDER BY events DESC, person LIMIT 6),
    c AS (SELECT person, CAST(date_trunc('year', "start") AS DATE) AS period, count(*) AS c FROM ex GROUP BY ALL)
    SELECT person, {day('period')} AS period, coalesce(c, 0) AS events
    FROM top CROSS JOIN (SELECT DISTINCT period FROM c) LEFT JOIN c USING (person, period)""",
)
def person_trend_top(spark, folder):
    return op.trend_of_people(calendar(spark, folder))


@query(
    "fading_or_growing",
    f"""WITH {CAL}, c AS (SELECT owner_id, person, year, count(*) AS c FROM ex GROUP BY ALL),
    f AS (SELECT owner_id, person, min(year) AS first_year, sum(c) AS total FROM c GROUP BY ALL HAVING sum(c) >= 5),
    y AS (SELECT DISTINCT owner_id, year FROM c),
    g AS (SELECT owner_id, person, first_year, total, y.year, coalesce(c.c, 0) AS c FROM f JOIN y USING (owner_id)
      LEFT JOIN c USING (owner_id, person, year) WHERE y.year >= first_year)
    SELECT owner_id, person, {n('any_value(total)')} AS total_events, {r('regr_slope(c, year)')} AS slope_events_per_year,
    {n('any_value(first_year)')} AS first_year, {n('max(year)')} AS last_year FROM g GROUP BY owner_id, person HAVING count(*) >= 2""",
)
def fading_or_growing(spark, folder):
    return op.fading_or_growing(calendar(spark, folder), keys=["owner_id"])


_EDGES = """e AS (SELECT {ka}a.person AS person_a, b.person AS person_b, count(*) AS shared_events
    FROM ex a JOIN ex b ON a.id = b.id AND a.person < b.person GROUP BY {ka}a.person, b.person)"""


@query("friend_edges", f"WITH {CAL}, {_EDGES.format(ka='')} SELECT * FROM e")
def friend_edges(spark, folder):
    return op.friend_network_edges(calendar(spark, folder))


@query("friend_edges_owner", f"WITH {CAL}, {_EDGES.format(ka='a.owner_id, ')} SELECT * FROM e")
def friend_edges_owner(spark, folder):
    return op.friend_network_edges(calendar(spark, folder), keys=["owner_id"])


@query(
    "friend_network_top",
    f"""WITH {CAL}, {FREQ.format(k='owner_id, ')}, {_EDGES.format(ka='a.owner_id, ')},
    top AS (SELECT owner_id, person FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY events DESC, person) AS k FROM pf) WHERE k <= 10)
    SELECT e.* FROM e JOIN top x ON e.owner_id = x.owner_id AND e.person_a = x.person JOIN top y ON e.owner_id = y.owner_id AND e.person_b = y.person""",
)
def friend_network_top(spark, folder):
    return op.friend_network(calendar(spark, folder), 10, keys=["owner_id"])[1]


@query(
    "friend_network_top40",
    f"""WITH {CAL}, {FREQ.format(k='')}, {_EDGES.format(ka='')}, top AS (SELECT person FROM pf ORDER BY events DESC, person LIMIT 40)
    SELECT * FROM e WHERE person_a IN (SELECT person FROM top) AND person_b IN (SELECT person FROM top)""",
)
def friend_network_top40(spark, folder):
    return op.friend_network(calendar(spark, folder))[1]


@query(
    "days_since_seen",
    f"""WITH {CAL}, {FREQ.format(k='owner_id, ')} SELECT owner_id, person, {ts('last_seen')} AS last_seen,
    {r(f"date_diff('microsecond', last_seen, {AS_OF_SQL}) / 86400000000.0")} AS days_since_seen FROM pf""",
)
def days_since_seen(spark, folder):
    return op.days_since_seen(calendar(spark, folder), as_of(), keys=["owner_id"])


@query("shared_categories", f"WITH {CAL} SELECT DISTINCT owner_id, person, category FROM ex")
def shared_categories(spark, folder):
    return op.shared_categories(calendar(spark, folder), keys=["owner_id"])


@query(
    "last_event_with",
    f"""WITH {CAL} SELECT owner_id, person, title AS last_event_title, {ts('"start"')} AS last_event_date, location AS last_event_location
    FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, person ORDER BY "start" DESC, id) AS k FROM ex) WHERE k = 1""",
)
def last_event_with(spark, folder):
    return op.last_event_with(calendar(spark, folder), keys=["owner_id"])


@query(
    "named_trends",
    f"""WITH {CAL}, c AS (SELECT person, CAST(date_trunc('month', "start") AS DATE) AS period, count(*) AS c FROM ex GROUP BY ALL)
    SELECT person, {day('period')} AS period, coalesce(c, 0) AS events FROM (SELECT DISTINCT person FROM c WHERE person IN ('S1', 'S7', 'S39'))
    CROSS JOIN (SELECT DISTINCT period FROM c) LEFT JOIN c USING (person, period)""",
)
def named_trends(spark, folder):
    return op.trend_of_people(calendar(spark, folder), "month", ["S1", "S7", "S39", "nobody"])


@query(
    "people_overview",
    f"""WITH {CAL}, {FREQ.format(k='')}, c AS (SELECT person, year, count(*) AS c FROM ex GROUP BY ALL),
    f AS (SELECT person, min(year) AS first_year FROM c GROUP BY 1 HAVING sum(c) >= 5),
    g AS (SELECT person, year, coalesce(c, 0) AS c FROM f CROSS JOIN (SELECT DISTINCT year FROM c) y LEFT JOIN c USING (person, year) WHERE year >= first_year),
    s AS (SELECT person, regr_slope(c, year) AS slope FROM g GROUP BY 1 HAVING count(*) >= 2),
    d AS (SELECT *, greatest(0, CAST(floor(date_diff('microsecond', last_seen, {AS_OF_SQL}) / 86400000000.0) AS BIGINT)) AS seen,
      greatest(0, CAST(floor(date_diff('microsecond', first_seen, {AS_OF_SQL}) / 86400000000.0) AS BIGINT)) AS tenure FROM pf LEFT JOIN s USING (person))
    SELECT {COLUMNS}, {r('total_hours / sum(total_hours) OVER ()')} AS share_of_social_hours, {r('slope')} AS slope_events_per_year,
    seen AS last_seen_days, CASE WHEN seen <= 14 THEN 'good' WHEN seen <= 45 THEN 'warning' ELSE 'critical' END AS last_seen_bucket,
    tenure AS tenure_days, CASE WHEN tenure < 30 THEN tenure || 'd' WHEN tenure < 365 THEN CAST(floor(tenure / 30 + 0.5) AS BIGINT) || 'mo'
      ELSE format('{{:.1f}}yr', tenure / 365) END AS tenure, {r('least(abs(slope) / 5, 1)')} AS trend_strength,
    CASE WHEN slope IS NULL THEN NULL WHEN abs(slope) < 0.05 THEN 'flat' WHEN slope > 0 THEN 'growing' ELSE 'fading' END AS trend FROM d""",
)
def people_overview(spark, folder):
    return op.people_overview(calendar(spark, folder), as_of())
