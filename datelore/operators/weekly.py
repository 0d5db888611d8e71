"""Weekly series: load, habits, anomalies and phases.

Events are summed per calendar and week before anything ordered happens, so
every window below works on at most one row per week (and category).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelore.functions.timebins import week_ending
from datelore.operators.common import fill_weeks
from datelore.operators.filters import in_category, not_in_category, timed_events
from datelore.operators.sequences import runs


def _weekly_sums(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return df.groupBy(*group, week_ending(F.col("start")).alias("week")).agg(
        F.coalesce(F.sum("duration_hours"), F.lit(0.0)).alias("total_hours"), F.count("*").alias("event_count")
    )


def weekly_load(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hours and events per week that ends on ``week``, timed events only, no week missing."""
    weekly = _weekly_sums(timed_events(df).filter(F.col("start").isNotNull()), keys)
    return fill_weeks(weekly, keys, "week", ["total_hours", "event_count"])


def weekly_load_by_category(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hours per week and category over the calendar's whole week range."""
    timed = timed_events(df).filter(F.col("start").isNotNull() & F.col("category").isNotNull())
    weekly = _weekly_sums(timed, [*keys, "category"])
    bounds = weekly.groupBy(*keys).agg(F.min("week").alias("first_week"), F.max("week").alias("last_week"))
    filled = fill_weeks(weekly, [*keys, "category"], "week", ["total_hours"], bounds, keys)
    return filled.withColumnRenamed("total_hours", "hours")


def _with_z_score(weekly: DataFrame, group: Sequence[str], value: Column) -> DataFrame:
    """Sample z-score per group; groups without variation have no rows."""
    whole = Window.partitionBy(*group)
    scored = weekly.withColumn("_value", value).withColumns(
        {"_mean": F.avg("_value").over(whole), "_std": F.stddev_samp("_value").over(whole)}
    )
    varied = scored.filter(F.col("_std") > 0)
    return varied.withColumn("z_score", (F.col("_value") - F.col("_mean")) / F.col("_std")).drop("_value", "_mean", "_std")


def anomaly_label(z: Column, threshold: float) -> Column:
    return F.when(z >= threshold, "packed").when(z <= -threshold, "empty").otherwise("typical")


def anomalous_weeks(df: DataFrame, z_threshold: float = 2.0, keys: Sequence[str] = ()) -> DataFrame:
    """Weeks far from the calendar's own mean; z is taken on log(1 + hours)."""
    scored = _with_z_score(weekly_load(df, keys), keys, F.log1p("total_hours"))
    labelled = scored.withColumn("label", anomaly_label(F.col("z_score"), z_threshold))
    return labelled.filter(F.col("label") != "typical")


def flagged_weeks(df: DataFrame, z_threshold: float = 2.0, keys: Sequence[str] = ()) -> DataFrame:
    """Every week with the label of its anomaly, or null."""
    labels = anomalous_weeks(df, z_threshold, keys).select(*keys, "week", "label")
    return weekly_load(df, keys).join(labels, [*keys, "week"], "left")


def category_anomalies(
    df: DataFrame, z_threshold: float = 2.0, min_active_weeks: int = 4, keys: Sequence[str] = ()
) -> DataFrame:
    """Anomalous weeks of each category against its own mean."""
    group = [*keys, "category"]
    weekly = weekly_load_by_category(df, keys)
    active = F.count_if(F.col("hours") > 0).over(Window.partitionBy(*group))
    enough = weekly.withColumn("_active", active).filter(F.col("_active") >= min_active_weeks).drop("_active")
    scored = _with_z_score(enough, group, F.log1p("hours"))
    labelled = scored.withColumn("label", anomaly_label(F.col("z_score"), z_threshold))
    return labelled.filter(F.col("label") != "typical")


def quiet_stretches(df: DataFrame, min_weeks: int = 3, z_threshold: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Runs of unusually quiet weeks; z is taken on the hours themselves."""
    scored = _with_z_score(weekly_load(df, keys), keys, F.col("total_hours"))
    quiet = scored.withColumn("_quiet", F.col("z_score") <= -z_threshold)
    found = runs(quiet, keys, "week", "_quiet")
    return found.filter(F.col("_quiet") & (F.col("weeks") >= min_weeks)).drop("_quiet")


def weekly_habit_counts(df: DataFrame, category: str, keys: Sequence[str] = ()) -> DataFrame:
    """Weekly events of one category between its first and last week; all-day events count."""
    weekly = _weekly_sums(in_category(df, category).filter(F.col("start").isNotNull()), keys)
    filled = fill_weeks(weekly, keys, "week", ["event_count"])
    return filled.withColumnRenamed("event_count", "count")


def busy_week_hours(df: DataFrame, exclude_category: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Weekly hours of everything but one category, all-day events included."""
    weekly = _weekly_sums(not_in_category(df, exclude_category).filter(F.col("start").isNotNull()), keys)
    return fill_weeks(weekly, keys, "week", ["total_hours"]).withColumnRenamed("total_hours", "busy_hours")


def streaks_and_gaps(weekly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Runs of active and inactive weeks of a weekly habit series."""
    return runs(weekly.withColumn("active", F.col("count") > 0), keys, "week", "active")


def longest_runs(streaks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Length of the longest active run and of the longest gap."""
    return streaks.groupBy(*keys).agg(
        F.max(F.when(F.col("active"), F.col("weeks"))).alias("longest_active_weeks"),
        F.max(F.when(~F.col("active"), F.col("weeks"))).alias("longest_gap_weeks"),
    )


def consistency_by_year(weekly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    counted = weekly.groupBy(*keys, F.year("week").alias("year")).agg(
        F.count_if(F.col("count") > 0).alias("active_weeks"), F.count("*").alias("total_weeks")
    )
    return counted.withColumn("consistency", F.col("active_weeks") / F.col("total_weeks"))


def habit_vs_busyness(df: DataFrame, category: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of weekly habit counts with the other hours of those weeks.

    Null with fewer than three common weeks or when one side is constant.
    """
    habit = weekly_habit_counts(df, category, keys)
    busy = busy_week_hours(df, category, keys)
    aligned = habit.join(busy, [*keys, "week"])
    stats = aligned.groupBy(*keys).agg(
        F.count("*").alias("n_weeks"),
        F.covar_samp("count", "busy_hours").alias("_covariance"),
        (F.stddev_samp("count") * F.stddev_samp("busy_hours")).alias("_spread"),
    )
    correlation = F.when(
        (F.col("n_weeks") >= 3) & (F.col("_spread") > 0), F.try_divide(F.col("_covariance"), F.col("_spread"))
    )
    return stats.select(*keys, "n_weeks", correlation.alias("correlation"))


def category_phases(
    df: DataFrame, min_weeks: int = 8, min_total_events: int = 8, keys: Sequence[str] = ()
) -> DataFrame:
    """Long active runs and long breaks of every category with enough events.

    Events are counted per category as written; its weeks are those of every
    spelling that differs only in case.
    """
    group = [*keys, "_folded"]
    dated = df.filter(F.col("start").isNotNull() & F.col("category").isNotNull())
    cells = dated.groupBy(*keys, "category", week_ending(F.col("start")).alias("week")).agg(F.count("*").alias("_n"))
    named = (
        cells.groupBy(*keys, "category")
        .agg(F.sum("_n").alias("_events"))
        .filter(F.col("_events") >= min_total_events)
        .select(*keys, "category", F.lower("category").alias("_folded"))
    )
    weekly = cells.groupBy(*keys, F.lower("category").alias("_folded"), "week").agg(F.sum("_n").alias("count"))
    # Only categories that qualify are spread over their weeks.
    weekly = weekly.join(named.select(*group).distinct(), group, "left_semi")
    series = fill_weeks(weekly, group, "week", ["count"])
    long_runs = streaks_and_gaps(series, group).filter(F.col("weeks") >= min_weeks)
    kind = F.when(F.col("active"), "active").otherwise("break")
    return long_runs.join(named, group).select(*keys, "category", kind.alias("type"), "start", "end", "weeks")


def phase_spans(phases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total days covered by the active phases of each category."""
    return phases.filter(F.col("type") == "active").groupBy(*keys, "category").agg(F.sum(F.datediff("end", "start")).alias("total_days"))
