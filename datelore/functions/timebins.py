"""Calendar buckets and the labels derived from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: seasons, cadence limits, status limits ---
SEASONS = ["winter", "spring", "summer", "fall"]
SEASON_OF_MONTH = {
    12: "winter", 1: "winter", 2: "winter",
    3: "spring", 4: "spring", 5: "spring",
    6: "summer", 7: "summer", 8: "summer",
    9: "fall", 10: "fall", 11: "fall",
}
CADENCE_LIMITS = [(2, "daily"), (9, "weekly"), (18, "biweekly"), (45, "monthly"), (100, "quarterly")]
CADENCE_OTHERWISE = "yearly"
STATUS_LIMITS = [(1.5, "active"), (3, "slowing down")]
STATUS_OTHERWISE = "stopped"
LAST_SEEN_LIMITS = [(14, "good"), (45, "warning")]
LAST_SEEN_OTHERWISE = "critical"
TREND_CAP_PER_YEAR = 5
TREND_FLAT_BELOW = 0.05
# --- end of fixed values ---

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 86_400_000_000


def _by_limit(value: Column, limits, otherwise: str) -> Column:
    chain = None
    for limit, label in limits:
        test = value <= limit
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise(otherwise)


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from one naive timestamp to another.

    Taken from the fields of their difference, which needs no time zone.
    """
    gap = end - start
    parts = [("DAY", 86_400_000_000), ("HOUR", 3_600_000_000), ("MINUTE", 60_000_000)]
    whole = [F.extract(F.lit(name), gap).cast("bigint") * F.lit(size) for name, size in parts]
    seconds = (F.extract(F.lit("SECOND"), gap) * F.lit(1_000_000)).cast("bigint")
    return whole[0] + whole[1] + whole[2] + seconds


def epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def naive(moment: dt.datetime | dt.date) -> Column:
    """A Python moment as naive timestamp, untouched by any time zone."""
    return F.lit(moment.isoformat()).cast("timestamp_ntz")


def instant(ts: Column) -> Column:
    """The moment a naive UTC timestamp stands for, for operators that need one."""
    return F.timestamp_micros(micros_between(epoch(), ts))


def hours_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_HOUR))


def days_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_DAY))


def whole_days_between(start: Column, end: Column) -> Column:
    return F.floor(days_between(start, end))


def week_ending(ts: Column) -> Column:
    """The Sunday on or after the day of ``ts``."""
    return F.date_add(F.to_date(ts), F.pmod(F.lit(8) - F.dayofweek(ts), F.lit(7)))


def month_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "month")


def year_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "year")


def quarter_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "quarter")


PERIODS = {"year": year_start, "month": month_start, "week": week_ending}


def period_start(ts: Column, granularity: str) -> Column:
    if granularity not in PERIODS:
        raise ValueError(f"granularity must be one of {sorted(PERIODS)}, got {granularity!r}")
    return PERIODS[granularity](ts)


def period_label(period: Column, granularity: str) -> Column:
    pattern = {"year": "yyyy", "month": "yyyy-MM", "week": "yyyy-MM-dd"}[granularity]
    return F.date_format(period, pattern)


def season(month: Column) -> Column:
    chain = None
    for name in SEASONS:
        months = [m for m, label in SEASON_OF_MONTH.items() if label == name]
        chain = F.when(month.isin(months), name) if chain is None else chain.when(month.isin(months), name)
    return chain


def weekday_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def week_strip_column(day: Column) -> Column:
    """Zero-based seven-day column of a day inside its year."""
    return F.floor((F.dayofyear(day) - 1) / 7).cast("int")


def cadence_label(median_days: Column) -> Column:
    return _by_limit(median_days, CADENCE_LIMITS, CADENCE_OTHERWISE)


def recurrence_status(days_since: Column, median_days: Column) -> Column:
    return _by_limit(days_since / median_days, STATUS_LIMITS, STATUS_OTHERWISE)


def last_seen_days(last_seen: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), whole_days_between(last_seen, as_of))


def last_seen_bucket(days: Column) -> Column:
    return _by_limit(days, LAST_SEEN_LIMITS, LAST_SEEN_OTHERWISE)


def tenure_label(days: Column) -> Column:
    """"45d", "6mo" or "2.3yr"."""
    return (
        F.when(days < 30, F.concat(days.cast("string"), F.lit("d")))
        .when(days < 365, F.concat(F.floor(days / 30 + 0.5).cast("string"), F.lit("mo")))
        .otherwise(F.format_string("%.1fyr", days / 365))
    )


def trend_strength(slope: Column) -> Column:
    """Share of the trend bar that is filled, between 0 and 1."""
    return F.least(F.abs(slope) / TREND_CAP_PER_YEAR, F.lit(1.0))


def trend_direction(slope: Column) -> Column:
    return F.when(F.abs(slope) < TREND_FLAT_BELOW, "flat").when(slope > 0, "growing").otherwise("fading")
