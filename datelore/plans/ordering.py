"""Sort orders of the report tables, applied where a table leaves Spark.

Operators return unordered rows. These orders are total: every list ends in the
columns that identify a row. Nulls come last in both directions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.operators.common import limit_per_key
from datelore.operators.recurring import report_order
from datelore.operators.sequences import ranked
from datelore.plans.reports import Report


def down(name: str) -> Column:
    return F.col(name).desc_nulls_last()


def up(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def _orders() -> dict[str, list[Column]]:
    return {
        "categories": [down("estimated_spend"), up("category")],
        "locations": [down("visits"), up("location")],
        "people": [down("events"), up("person")],
        "trends": [up("slope_events_per_year"), up("person")],
        "edges": [down("shared_events"), up("person_a"), up("person_b")],
        "nodes": [down("events"), up("person")],
        "trend": [up("person"), up("period")],
        "weekly": [up("week")],
        "streaks": [down("weeks"), up("start")],
        "consistency": [up("year")],
        "category_phases": [up("start"), up("category")],
        "phase_spans": [down("total_days"), up("category")],
        "quiet_stretches": [up("start")],
        "location_shifts": [up("quarter")],
        "region_visits": [down("visits"), up("region")],
        "region_trips": [up("start"), up("region")],
        "trips_by_region": [down("last_end"), up("region")],
        "tagged_trips": [up("start"), up("destination")],
        "neighborhoods": [down("visits"), up("neighborhood")],
        "anomalies": [down("z_score"), up("week")],
        "by_category": [F.abs("z_score").desc_nulls_last(), up("category"), up("week")],
        "by_reason": [down("places"), up("reason")],
        "failures": [up("location")],
        "approximate": [up("location")],
        "events": [up("start"), up("id")],
        "upcoming_invites": [up("event_start"), up("event_title"), up("person")],
    }


def display_order(name: str, table: DataFrame) -> list[Column]:
    """The sort columns of one report table; none for unknown tables."""
    if name == "series":
        return report_order()
    if name == "categories" and "estimated_spend" not in table.columns:
        return [down("events"), up("category")]
    if name == "people" and "events" not in table.columns:
        return [up("person")]
    return _orders().get(name, [])


def ordered(name: str, table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One report table in its display order, calendar by calendar; unknown tables come back as they are."""
    order = display_order(name, table)
    return table.orderBy(*keys, *order) if order else table


def ordered_report(report: Report, keys: Sequence[str] = ()) -> Report:
    return {name: ordered(name, table, keys) for name, table in report.items()}


def numbered(name: str, table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One report table with ``rank``, the place of each row in its calendar's display order."""
    return ranked(table, keys, display_order(name, table))


def first_rows(name: str, table: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The first n rows of every calendar in display order, such as the 12 longest streaks."""
    return ordered(name, limit_per_key(table, keys, display_order(name, table), n), keys)
