from __future__ import annotations

from datelore.operators import time_use as op
from datelore.plans import ordering
from datelore.sources import tables as t
from workload.registry import ORACLES, query
from workload.sql import CAL, EVT, day, n, r

COSTS = {"1-urgent": 45.0, "2-HIGH": 25.0, "3-Medium": 8.0}
COST_SQL = "costs(k, cost) AS (VALUES ('1-urgent', 45.0), ('2-high', 25.0), ('3-medium', 8.0))"


@query(
    "time_by_category",
    f"""WITH {CAL} SELECT category, count(*) AS events, {r('sum(duration_hours)')} AS total_hours,
    {r('sum(duration_hours) / sum(sum(duration_hours)) OVER ()')} AS share_of_hours FROM timed GROUP BY category""",
)
def time_by_category(spark, folder):
    return op.time_by_category(t.order_calendar(spark, folder))


@query(
    "time_by_category_owner",
    f"""WITH {CAL} SELECT owner_id, category, count(*) AS events, {r('sum(duration_hours)')} AS total_hours,
    {r('sum(duration_hours) / sum(sum(duration_hours)) OVER (PARTITION BY owner_id)')} AS share_of_hours
    FROM timed GROUP BY owner_id, category""",
)
def time_by_category_owner(spark, folder):
    return op.time_by_category(t.order_calendar(spark, folder), keys=["owner_id"])


@query(
    "estimated_spend",
    f"""WITH {CAL}, {COST_SQL}, g AS (SELECT category, count(*) AS events, sum(duration_hours) AS h FROM timed GROUP BY category)
    SELECT category, events, {r('h')} AS total_hours, {r('h / sum(h) OVER ()')} AS share_of_hours,
    {r('cost')} AS cost_per_visit, {r('events * cost')} AS estimated_spend FROM g LEFT JOIN costs ON lower(category) = k""",
)
def estimated_spend(spark, folder):
    return op.estimated_spend_by_category(t.order_calendar(spark, folder), COSTS)


@query("ranked_spend", f"""SELECT *, row_number() OVER (ORDER BY estimated_spend DESC NULLS LAST, category) AS rank FROM ({ORACLES["estimated_spend"]})""")
def ranked_spend(spark, folder):
    return ordering.numbered("categories", estimated_spend(spark, folder))


@query(
    "spend_by_year",
    f"""WITH {CAL}, {COST_SQL}, p AS (SELECT year, category, sum(cost) AS spend FROM timed JOIN costs ON lower(category) = k GROUP BY 1, 2)
    SELECT {n('y.year')} AS year, c.category, {r('coalesce(spend, 0)')} AS spend
    FROM (SELECT DISTINCT year FROM p) y CROSS JOIN (SELECT DISTINCT category FROM p) c LEFT JOIN p USING (year, category)""",
)
def spend_by_year(spark, folder):
    return op.spend_by_year(t.order_calendar(spark, folder), COSTS)


@query(
    "spend_by_year_owner",
    f"""WITH {CAL}, {COST_SQL}, p AS (SELECT owner_id, year, category, sum(cost) AS spend FROM timed JOIN costs ON lower(category) = k GROUP BY ALL)
    SELECT owner_id, {n('y.year')} AS year, c.category, {r('coalesce(spend, 0)')} AS spend
    FROM (SELECT DISTINCT owner_id, year FROM p) y JOIN (SELECT DISTINCT owner_id, category FROM p) c USING (owner_id)
    LEFT JOIN p USING (owner_id, year, category)""",
)
def spend_by_year_owner(spark, folder):
    return op.spend_by_year(t.order_calendar(spark, folder), COSTS, keys=["owner_id"])


@query(
    "monthly_activity",
    f"""WITH {CAL} SELECT {n('m.month')} AS month, {r('count(t.id) / (SELECT greatest(count(DISTINCT year), 1) FROM timed)')} AS avg_events_per_month
    FROM (SELECT unnest(range(1, 13)) AS month) m LEFT JOIN timed t ON t.month = m.month GROUP BY m.month""",
)
def monthly_activity(spark, folder):
    return op.monthly_activity(t.order_calendar(spark, folder))


@query(
    "seasonal_activity",
    f"""WITH {CAL}, o AS (SELECT * FROM timed WHERE lower(category) = '1-urgent')
    SELECT s.season, {r('count(o.id) / (SELECT greatest(count(DISTINCT year), 1) FROM o)')} AS avg_events_per_season
    FROM (SELECT unnest(['winter', 'spring', 'summer', 'fall']) AS season) s LEFT JOIN o ON o.season = s.season GROUP BY s.season""",
)
def seasonal_activity(spark, folder):
    return op.seasonal_activity(t.order_calendar(spark, folder), "1-Urgent")


_SEASON_COLUMNS = ", ".join(
    f"{r(f'count(*) FILTER (season = {s!r}) / count(DISTINCT year)')} AS {s}" for s in ["winter", "spring", "summer", "fall"]
)


@query(
    "category_seasonality",
    f"WITH {CAL} SELECT owner_id, category, {_SEASON_COLUMNS} FROM timed GROUP BY owner_id, category",
)
def category_seasonality(spark, folder):
    return op.category_seasonality(t.order_calendar(spark, folder), keys=["owner_id"])


@query(
    "category_colors",
    f"""WITH {CAL}, g AS (SELECT category, calendar_color, count(*) AS c FROM cal WHERE calendar_color IS NOT NULL GROUP BY ALL)
    SELECT category, calendar_color FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY c DESC, calendar_color) AS k FROM g) WHERE k = 1""",
)
def category_colors(spark, folder):
    return op.category_colors(t.order_calendar(spark, folder))


@query(
    "summary",
    f"""WITH {CAL}, c AS (SELECT owner_id, category, count(*) AS c FROM cal GROUP BY ALL),
    top AS (SELECT owner_id, category FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY c DESC, category) AS k FROM c) WHERE k = 1),
    p AS (SELECT owner_id, count(DISTINCT person) AS n_people FROM (SELECT owner_id, unnest(people) AS person FROM cal) GROUP BY 1)
    SELECT owner_id, count(*) AS total_events, {r('sum(duration_hours)')} AS total_hours, any_value(top.category) AS top_category,
    any_value(coalesce(n_people, 0)) AS n_people FROM cal JOIN top USING (owner_id) LEFT JOIN p USING (owner_id) GROUP BY owner_id""",
)
def summary(spark, folder):
    return op.summary(t.order_calendar(spark, folder, people=True), keys=["owner_id"])


@query(
    "meta_bounds",
    f"""WITH {EVT} SELECT count(*) AS total_events, {n('min(year)')} AS min_year, {n('max(year)')} AS max_year,
    {day('min("start")')} AS min_date, {day('max("start")')} AS max_date FROM evt""",
)
def meta_bounds(spark, folder):
    return op.date_bounds(t.event_calendar(spark, folder))


@query("meta_categories", f"WITH {EVT} SELECT category, count(*) AS events FROM evt GROUP BY category")
def meta_categories(spark, folder):
    return op.categories_by_events(t.event_calendar(spark, folder))


@query("distinct_people", f"WITH {EVT} SELECT DISTINCT owner_id, unnest(people) AS person FROM evt")
def distinct_people(spark, folder):
    return op.distinct_people(t.event_calendar(spark, folder), keys=["owner_id"])


@query("distinct_locations", f"WITH {CAL} SELECT DISTINCT location FROM cal WHERE location IS NOT NULL")
def distinct_locations(spark, folder):
    return op.distinct_locations(t.order_calendar(spark, folder))
