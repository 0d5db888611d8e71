from __future__ import annotations

from pyspark.sql import functions as F

from datelore.operators import weekly as op
from datelore.plans import ordering
from datelore.sources import tables as t
from workload.registry import ORACLES, query
from workload.sql import CAL, EVT, day, filled_weeks, n, r

HABIT = "1-urgent"


def _load(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""WITH {CAL}, w AS (SELECT {k}week, sum(duration_hours) AS h, count(*) AS c FROM timed GROUP BY ALL),
{filled_weeks('w', 'wl', keys, ['h', 'c'])}"""


@query("weekly_load", f"{_load()} SELECT {day('week')} AS week, {r('h')} AS total_hours, {n('c')} AS event_count FROM wl")
def weekly_load(spark, folder):
    return op.weekly_load(t.order_calendar(spark, folder))


@query(
    "weekly_load_owner",
    f"{_load('owner_id')} SELECT owner_id, {day('week')} AS week, {r('h')} AS total_hours, {n('c')} AS event_count FROM wl",
)
def weekly_load_owner(spark, folder):
    return op.weekly_load(t.order_calendar(spark, folder), keys=["owner_id"])


_BY_CATEGORY = f"""WITH {CAL}, w AS (SELECT owner_id, category, week, sum(duration_hours) AS h FROM timed GROUP BY ALL),
range_of AS (SELECT owner_id, min(week) AS lo, max(week) AS hi FROM w GROUP BY owner_id),
{filled_weeks('w', 'wc', 'owner_id, category', ['h'], 'SELECT owner_id, category, lo, hi FROM (SELECT DISTINCT owner_id, category FROM w) JOIN range_of USING (owner_id)')}"""


@query(
    "weekly_load_by_category",
    f"{_BY_CATEGORY} SELECT owner_id, category, {day('week')} AS week, {r('h')} AS hours FROM wc",
)
def weekly_load_by_category(spark, folder):
    return op.weekly_load_by_category(t.order_calendar(spark, folder), keys=["owner_id"])


def _z(value: str, part: str, source: str, name: str) -> str:
    over = f"OVER ({'PARTITION BY ' + part if part else ''})"
    return f"""{name}_m AS (SELECT *, {value} AS v, avg({value}) {over} AS m, stddev_samp({value}) {over} AS sd FROM {source}),
{name} AS (SELECT *, (v - m) / sd AS z FROM {name}_m WHERE sd > 0)"""


def _label(t: float) -> str:
    return f"CASE WHEN z >= {t} THEN 'packed' WHEN z <= -{t} THEN 'empty' ELSE 'typical' END"


@query(
    "anomalous_weeks",
    f"""{_load('owner_id')}, {_z('ln(1 + h)', 'owner_id', 'wl', 'zs')}
    SELECT owner_id, {day('week')} AS week, {r('h')} AS total_hours, {n('c')} AS event_count, {r('z')} AS z_score, {_label(2.0)} AS label
    FROM zs WHERE abs(z) >= 2.0""",
)
def anomalous_weeks(spark, folder):
    return op.anomalous_weeks(t.order_calendar(spark, folder), keys=["owner_id"])


@query(
    "flagged_weeks",
    f"""{_load()}, {_z('ln(1 + h)', '', 'wl', 'zs')}
    SELECT {day('wl.week')} AS week, {r('wl.h')} AS total_hours, {n('wl.c')} AS event_count,
    CASE WHEN abs(z) >= 2.0 THEN {_label(2.0)} END AS label FROM wl LEFT JOIN zs ON zs.week = wl.week""",
)
def flagged_weeks(spark, folder):
    return op.flagged_weeks(t.order_calendar(spark, folder))


@query(
    "category_anomalies",
    f"""{_BY_CATEGORY}, act AS (SELECT owner_id, category FROM wc GROUP BY ALL HAVING count(*) FILTER (h > 0) >= 4),
    wa AS (SELECT wc.* FROM wc JOIN act USING (owner_id, category)), {_z('ln(1 + h)', 'owner_id, category', 'wa', 'zs')}
    SELECT owner_id, category, {day('week')} AS week, {r('h')} AS hours, {r('z')} AS z_score, {_label(2.0)} AS label FROM zs WHERE abs(z) >= 2.0""",
)
def category_anomalies(spark, folder):
    return op.category_anomalies(t.order_calendar(spark, folder), keys=["owner_id"])


@query(
    "ranked_anomalies",
    f"""SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY abs(z_score) DESC, category, week) AS rank FROM ({ORACLES["category_anomalies"]})""",
)
def ranked_anomalies(spark, folder):
    """Unusual weeks of all categories, the most unusual first whichever way."""
    found = category_anomalies(spark, folder).withColumn("z_score", F.round("z_score", 6))
    return ordering.numbered("by_category", found, ["owner_id"])


def _runs(source: str, part: str, state: str, name: str) -> str:
    by = f"PARTITION BY {part}" if part else ""
    k = f"{part}, " if part else ""
    return f"""{name} AS (SELECT {k}st, min(week) AS "start", max(week) AS "end", count(*) AS weeks FROM (
      SELECT *, row_number() OVER ({by} ORDER BY week) - row_number() OVER (PARTITION BY {k}st ORDER BY week) AS grp
      FROM (SELECT *, {state} AS st FROM {source})) GROUP BY {k}st, grp)"""


SPAN = f'{day(chr(34) + "start" + chr(34))} AS "start", {day(chr(34) + "end" + chr(34))} AS "end", weeks'


@query(
    "quiet_stretches",
    f"""{_load('owner_id')}, {_z('h', 'owner_id', 'wl', 'zs')}, {_runs('zs', 'owner_id', 'z <= -0.5', 'rn')}
    SELECT owner_id, {SPAN} FROM rn WHERE st AND weeks >= 3""",
)
def quiet_stretches(spark, folder):
    return op.quiet_stretches(t.order_calendar(spark, folder), 3, 0.5, keys=["owner_id"])


_HABIT = f"""WITH {CAL}, w AS (SELECT owner_id, week, count(*) AS c FROM cal WHERE lower(category) = '{HABIT}' GROUP BY ALL),
{filled_weeks('w', 'hb', 'owner_id', ['c'])}"""


@query("weekly_habit", f"{_HABIT} SELECT owner_id, {day('week')} AS week, {n('c')} AS count FROM hb")
def weekly_habit(spark, folder):
    return op.weekly_habit_counts(t.order_calendar(spark, folder), HABIT, keys=["owner_id"])


@query(
    "busy_week_hours",
    f"""WITH {CAL}, w AS (SELECT week, sum(duration_hours) AS h FROM cal WHERE lower(category) <> '{HABIT}' GROUP BY ALL),
    {filled_weeks('w', 'bz', '', ['h'])} SELECT {day('week')} AS week, {r('h')} AS busy_hours FROM bz""",
)
def busy_week_hours(spark, folder):
    return op.busy_week_hours(t.order_calendar(spark, folder), HABIT)


@query("streaks", f"{_HABIT}, {_runs('hb', 'owner_id', 'c > 0', 'rn')} SELECT owner_id, {SPAN}, st AS active FROM rn")
def streaks(spark, folder):
    keys = ["owner_id"]
    return op.streaks_and_gaps(op.weekly_habit_counts(t.order_calendar(spark, folder), HABIT, keys), keys)


@query(
    "top_streaks",
    f"""SELECT * FROM ({ORACLES["streaks"]}) QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY weeks DESC, "start") <= 3""",
)
def top_streaks(spark, folder):
    return ordering.first_rows("streaks", streaks(spark, folder), 3, ["owner_id"])


@query(
    "longest_runs",
    f"""{_HABIT}, {_runs('hb', 'owner_id', 'c > 0', 'rn')} SELECT owner_id, max(weeks) FILTER (st) AS longest_active_weeks,
    max(weeks) FILTER (NOT st) AS longest_gap_weeks FROM rn GROUP BY owner_id""",
)
def longest_runs(spark, folder):
    keys = ["owner_id"]
    weekly = op.weekly_habit_counts(t.order_calendar(spark, folder), HABIT, keys)
    return op.longest_runs(op.streaks_and_gaps(weekly, keys), keys)


@query(
    "consistency",
    f"""{_HABIT} SELECT owner_id, {n('year(week)')} AS year, count(*) FILTER (c > 0) AS active_weeks, count(*) AS total_weeks,
    {r('count(*) FILTER (c > 0) / count(*)')} AS consistency FROM hb GROUP BY owner_id, year(week)""",
)
def consistency(spark, folder):
    keys = ["owner_id"]
    return op.consistency_by_year(op.weekly_habit_counts(t.order_calendar(spark, folder), HABIT, keys), keys)


@query(
    "habit_correlation",
    f"""{_HABIT}, w2 AS (SELECT owner_id, week, sum(duration_hours) AS h FROM cal WHERE lower(category) <> '{HABIT}' GROUP BY ALL),
    {filled_weeks('w2', 'bz', 'owner_id', ['h'])}
    SELECT owner_id, count(*) AS n_weeks, {r('CASE WHEN count(*) >= 3 AND stddev_samp(c) > 0 AND stddev_samp(h) > 0 THEN corr(c, h) END')} AS correlation
    FROM hb JOIN bz USING (owner_id, week) GROUP BY owner_id""",
)
def habit_correlation(spark, folder):
    return op.habit_vs_busyness(t.order_calendar(spark, folder), HABIT, keys=["owner_id"])


_PHASES = f"""WITH {CAL}, named AS (SELECT owner_id, category FROM cal GROUP BY ALL HAVING count(*) >= 8),
    w AS (SELECT owner_id, category, week, count(*) AS c FROM cal JOIN named USING (owner_id, category) GROUP BY ALL),
    {filled_weeks('w', 'ph', 'owner_id, category', ['c'])}, {_runs('ph', 'owner_id, category', 'c > 0', 'rn')}"""


@query(
    "category_phases",
    f"{_PHASES} SELECT owner_id, category, CASE WHEN st THEN 'active' ELSE 'break' END AS type, {SPAN} FROM rn WHERE weeks >= 4",
)
def category_phases(spark, folder):
    return op.category_phases(t.order_calendar(spark, folder), 4, keys=["owner_id"])


@query(
    "phase_spans",
    f"""{_PHASES} SELECT owner_id, category, {n('sum(date_diff(' + chr(39) + 'day' + chr(39) + ', "start", "end"))')} AS total_days
    FROM rn WHERE weeks >= 2 AND st GROUP BY owner_id, category""",
)
def phase_spans(spark, folder):
    phases = op.category_phases(t.order_calendar(spark, folder), 2, keys=["owner_id"])
    return op.phase_spans(phases, keys=["owner_id"])


@query(
    "weekly_load_events",
    f"""WITH {EVT}, w AS (SELECT owner_id, week, sum(duration_hours) AS h, count(*) AS c FROM evt WHERE NOT is_all_day GROUP BY ALL),
    {filled_weeks('w', 'wl', 'owner_id', ['h', 'c'])} SELECT owner_id, {day('week')} AS week, {r('h')} AS total_hours, {n('c')} AS event_count FROM wl""",
)
def weekly_load_events(spark, folder):
    return op.weekly_load(t.event_calendar(spark, folder), keys=["owner_id"])
