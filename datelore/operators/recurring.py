"""Series of events that keep coming back under one title."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.functions import text, timebins
from datelore.operators.common import weighted_quantiles
from datelore.operators.sequences import gap_counts
from datelore.schema import as_utc_ntz

# --- Fixed values ---
TOO_RARE = ["quarterly", "yearly"]
STATUS_RANK = {"stopped": 0, "slowing down": 1, "active": 2}
# --- end of fixed values ---


def recurring_series(
    df: DataFrame, min_occurrences: int = 4, as_of: Column | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per title with enough occurrences: usual gap, cadence and status.

    Titles are compared without their guest list. ``as_of`` defaults to now. Series
    that recur less than monthly, or whose median gap is 0, are left out.
    """
    now = as_utc_ntz(F.current_timestamp()) if as_of is None else as_of
    group = [*keys, "title"]
    titled = (
        df.filter(F.col("title").isNotNull())
        .select(*keys, text.strip_with_suffix(F.col("title")).alias("title"), "category", "start")
    )
    by_category = titled.groupBy(*group, "category").agg(
        F.count("*").alias("_n"), F.min("start").alias("_first"), F.max("start").alias("_last")
    )
    named = F.when(F.col("category").isNotNull(), F.struct(-F.col("_n"), F.col("category")))
    series = (
        by_category.groupBy(*group)
        .agg(
            F.min_by("category", named).alias("category"),
            F.sum("_n").alias("occurrences"),
            F.min("_first").alias("first_seen"),
            F.max("_last").alias("last_seen"),
        )
        .filter(F.col("occurrences") >= min_occurrences)
    )
    gaps = gap_counts(titled, group)
    hour = F.floor(F.col("gap_micros") / F.lit(timebins.MICROS_PER_HOUR))
    medians = weighted_quantiles(gaps, group, "gap_micros", "n", {"_median": 0.5}, hour)
    median_days = F.col("_median") / F.lit(float(timebins.MICROS_PER_DAY))
    return (
        series.join(medians, group)
        .withColumns(
            {
                "streak_days": timebins.whole_days_between(F.col("first_seen"), F.col("last_seen")),
                "median_interval_days": median_days,
                "days_since_last": timebins.days_between(F.col("last_seen"), now),
            }
        )
        .filter(F.col("median_interval_days") > 0)
        .withColumns(
            {
                "status": timebins.recurrence_status(F.col("days_since_last"), F.col("median_interval_days")),
                "cadence": timebins.cadence_label(F.col("median_interval_days")),
            }
        )
        .filter(~F.col("cadence").isin(TOO_RARE))
        .drop("_median")
    )


def report_order() -> list[Column]:
    """Stopped series first, then slowing, then active; the longest silent first."""
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair]), F.col("status"))
    return [rank, F.col("days_since_last").desc(), F.col("title")]


def in_report_order(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return series.orderBy(*keys, *report_order())
