"""SQL pieces shared by the expected answers."""

from __future__ import annotations


def r(expr: str) -> str:
    """A double rounded like :func:`workload.registry.portable` does."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0"


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def n(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def joined(expr: str) -> str:
    return f"array_to_string({expr}, '|')"


_PARTS = """
    date_diff('microsecond', "start", "end") / 3600000000.0 AS duration_hours,
    year("start") AS year, month("start") AS month,
    CASE WHEN month("start") IN (12, 1, 2) THEN 'winter' WHEN month("start") IN (3, 4, 5) THEN 'spring'
         WHEN month("start") IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season,
    CAST("start" AS DATE) + CAST(7 - isodow("start") AS INTEGER) AS week,
    CAST(date_trunc('quarter', "start") AS DATE) AS quarter"""

# Orders as calendar events of a nation.
CAL = f"""ppl AS (
  SELECT l_orderkey, list_sort(list_distinct(list('S' || (l_suppkey % 40)))) AS people FROM lineitem GROUP BY l_orderkey),
cal0 AS (
  SELECT CAST(c_nationkey AS BIGINT) AS owner_id, CAST(o_orderkey AS VARCHAR) AS id,
    'Visit ' || (o_custkey % 50) || CASE WHEN o_orderkey % 4 = 0 THEN ' with Sam Lee and Priya' ELSE '' END AS title,
    CASE WHEN o_orderkey % 9 <> 0 THEN 'Nation ' || c_nationkey || ' / ' || (o_custkey % 8) END AS location,
    o_orderdate + to_hours(o_orderkey % 24) AS "start",
    o_orderdate + to_hours(o_orderkey % 24) + to_minutes(30 * (1 + o_orderkey % 6)) AS "end",
    o_orderkey % 11 = 0 AS is_all_day, c_mktsegment AS calendar, o_orderpriority AS category,
    CASE WHEN o_orderkey % 5 <> 0 THEN '#00000' || (o_orderkey % 3) END AS calendar_color,
    coalesce(people, []) AS people
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN ppl ON l_orderkey = o_orderkey),
cal AS (SELECT *, {_PARTS} FROM cal0),
timed AS (SELECT * FROM cal WHERE NOT is_all_day),
ex AS (SELECT * EXCLUDE (people), unnest(people) AS person FROM timed)"""

# Places of those events.
GEO = """geo AS (
  SELECT 'Nation ' || c_nationkey || ' / ' || spot AS location, c_nationkey AS nation, -60.0 + 5.0 * c_nationkey AS lat,
    -150.0 + 12.0 * c_nationkey + 0.1 * spot AS lon, 'Spot ' || spot || ', ' || n_name AS display_name,
    CASE WHEN spot < 5 THEN 'City ' ELSE 'Town ' END || c_nationkey AS city, 'Country ' || n_regionkey AS country,
    CASE WHEN spot % 3 <> 0 THEN 'Quarter ' || (spot % 3) END AS neighbourhood,
    CASE WHEN spot % 2 = 0 THEN 'commercial' END AS place_type
  FROM (SELECT DISTINCT c_nationkey, c_custkey % 8 AS spot FROM customer) JOIN nation ON c_nationkey = n_nationkey)"""

# Event rows as meetings of a user.
EVT = f"""evt0 AS (
  SELECT user_id AS owner_id, CAST(event_id AS VARCHAR) AS id, event_type || ' ' || (k % 7) AS title,
    CASE WHEN k % 5 <> 0 THEN 'Place ' || (k % 25) END AS location, ts AS "start",
    ts + to_minutes(CAST(floor(value) AS BIGINT)) AS "end", k % 10 = 0 AS is_all_day, event_type AS category,
    list_sort(list_distinct(['P' || (user_id % 10), 'P' || (k % 10)])) AS people
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
evt AS (SELECT *, {_PARTS} FROM evt0)"""

HAVERSINE = """2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2)
    + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"""


def filled_weeks(source: str, name: str, keys: str, values: list[str], bounds: str | None = None) -> str:
    """CTEs that add the missing weeks of ``source`` (keys, week, values) as zeros, named ``name``.

    ``bounds`` names a relation of (keys without category, lo, hi) that replaces each group's own range.
    """
    on = [k.strip() for k in keys.split(",") if k.strip()]
    grouped = f"{keys}, " if keys else ""
    group_by = f"GROUP BY {keys}" if keys else ""
    columns = ", ".join(f"coalesce(s.{v}, 0) AS {v}" for v in values)
    match = " AND ".join(["s.week = p.week", *[f"s.{k} = p.{k}" for k in on]])
    picked = ", ".join([f"p.{k}" for k in on] + ["p.week", columns])
    own = f"SELECT {grouped}min(week) AS lo, max(week) AS hi FROM {source} {group_by}"
    if bounds:
        own = bounds
    return f"""{name}_b AS ({own}),
{name}_p AS (SELECT {grouped}CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week
  FROM {name}_b WHERE lo IS NOT NULL),
{name} AS (SELECT {picked} FROM {name}_p p LEFT JOIN {source} s ON {match})"""
