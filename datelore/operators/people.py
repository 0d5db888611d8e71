"""Reports about the people events are shared with. All-day events do not count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.functions import timebins
from datelore.operators.common import attach_per_key, fill_grid, limit_per_key, reading_all, with_share
from datelore.operators.filters import timed_events


def exploded_people(df: DataFrame) -> DataFrame:
    """One row per timed event and person."""
    rest = [name for name in df.columns if name != "people"]
    return timed_events(df).select(*rest, F.explode("people").alias("person"))


def person_frequency(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return exploded_people(df).groupBy(*keys, "person").agg(
        F.count("id").alias("events"),
        F.sum("duration_hours").alias("total_hours"),
        F.min("start").alias("first_seen"),
        F.max("start").alias("last_seen"),
    )


def social_time_share(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return with_share(person_frequency(df, keys), "total_hours", "share_of_social_hours", keys)


def person_trend(
    df: DataFrame, granularity: str = "year", keys: Sequence[str] = (), wanted: DataFrame | None = None
) -> DataFrame:
    """Events per person and period, 0 for every observed period the person is missing from.

    ``period`` is the first day of a year or month, or the Sunday that ends a week.
    ``wanted`` (keys, person) limits the people, not the periods.
    """
    rows = exploded_people(df).select(*keys, "person", timebins.period_start(F.col("start"), granularity).alias("period"))
    counted = rows.groupBy(*keys, "person", "period").agg(F.count("*").alias("events"))
    return fill_grid(counted, keys, ["person"], "period", ["events"], wanted)


def person_trend_by_year(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return person_trend(df, "year", keys).select(*keys, "person", F.year("period").alias("year"), "events")


def person_trend_table(
    df: DataFrame, labels: Sequence[str], granularity: str = "year", keys: Sequence[str] = ()
) -> DataFrame:
    """The trend with one column for each of the given period labels, null where no one was seen."""
    long = person_trend(df, granularity, keys).withColumn("_label", timebins.period_label(F.col("period"), granularity))
    return long.groupBy(*keys, "person").pivot("_label", list(labels)).agg(F.sum("events"))


def trend_of_people(
    df: DataFrame,
    granularity: str = "year",
    people: Sequence[str] | None = None,
    top_n: int = 6,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The trend of the named people (possibly none), or of the ``top_n`` seen most."""
    if people is not None:
        named = exploded_people(df).select(*keys, "person").filter(F.col("person").isin(list(people))).distinct()
        return person_trend(df, granularity, keys, named)
    return person_trend(df, granularity, keys, top_people(df, top_n, keys).select(*keys, "person"))


def top_people(df: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    return limit_per_key(person_frequency(df, keys), keys, [F.col("events").desc(), F.col("person")], n)


def fading_or_growing(df: DataFrame, min_total_events: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope of yearly events per person, from the person's first year on.

    Years are those in which anyone was seen; a year without the person counts as
    0. Zero years add nothing to the sums over counts, so only the sums over the
    year axis need them and no person-by-year grid is built.
    """
    keys = list(keys)
    yearly = exploded_people(df).groupBy(*keys, "person", "year").agg(F.count("*").alias("_n"))
    axis = reading_all(yearly).groupBy(*keys).agg(F.sort_array(F.collect_set("year")).alias("_axis"))
    per_person = yearly.groupBy(*keys, "person").agg(
        F.sum("_n").alias("total_events"),
        F.min("year").alias("first_year"),
        F.sum(F.col("year").cast("long") * F.col("_n")).alias("_sum_year_n"),
    )
    joined = attach_per_key(per_person.filter(F.col("total_events") >= min_total_events), axis, keys)
    first = F.col("first_year")
    # Years count from the first active one, which keeps the sums small and exact.
    offsets = F.transform(F.filter("_axis", lambda year: year >= first), lambda year: (year - first).cast("double"))
    zero = F.lit(0.0)
    n = F.size("_x").cast("double")
    sum_x = F.aggregate("_x", zero, lambda acc, x: acc + x)
    sum_xx = F.aggregate("_x", zero, lambda acc, x: acc + x * x)
    sum_y = F.col("total_events").cast("double")
    sum_xy = (F.col("_sum_year_n") - first * F.col("total_events")).cast("double")
    slope = (n * sum_xy - sum_x * sum_y) / (n * sum_xx - sum_x * sum_x)
    return (
        joined.withColumn("_x", offsets)
        .filter(F.size("_x") >= 2)
        .select(
            *keys,
            "person",
            "total_events",
            slope.alias("slope_events_per_year"),
            "first_year",
            F.array_max("_axis").alias("last_year"),
        )
    )


def friend_network_edges(df: DataFrame, keys: Sequence[str] = (), within: DataFrame | None = None) -> DataFrame:
    """Unordered pairs of people at one timed event, weighted by shared events.

    Equal guest lists are counted before they are paired. ``within`` (keys,
    people) limits the pairs to the people of one list per calendar.
    """
    keys = list(keys)
    lists = timed_events(df).filter(F.size("people") > 1).select(*keys, F.sort_array(F.array_distinct("people")).alias("_p"))
    if within is not None:
        lists = attach_per_key(lists, within.withColumnRenamed("people", "_within"), keys)
        lists = lists.select(*keys, F.sort_array(F.array_intersect("_p", "_within")).alias("_p"))
    lists = lists.filter(F.size("_p") > 1).groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    # Two generators in a row stream the pairs of a list instead of building them as one array.
    first = lists.select(*keys, "_n", "_p", F.posexplode("_p").alias("_i", "person_a"))
    rest = F.slice("_p", F.col("_i") + 2, F.size("_p"))
    pairs = first.select(*keys, "_n", "person_a", F.explode(rest).alias("person_b"))
    return pairs.groupBy(*keys, "person_a", "person_b").agg(F.sum("_n").alias("shared_events"))


def friend_network(df: DataFrame, limit: int = 40, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes: the ``limit`` people seen most. Edges: pairs with both ends among them."""
    nodes = top_people(df, limit, keys)
    # At most ``limit`` names per calendar, so the list is small by construction.
    names = nodes.groupBy(*keys).agg(F.collect_list("person").alias("people"))
    return nodes, friend_network_edges(df, keys, within=names)


def days_since_seen(df: DataFrame, as_of: Column, keys: Sequence[str] = ()) -> DataFrame:
    seen = exploded_people(df).groupBy(*keys, "person").agg(F.max("start").alias("last_seen"))
    return seen.withColumn("days_since_seen", timebins.days_between(F.col("last_seen"), as_of))


def shared_categories(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct (person, category) rows."""
    return exploded_people(df).select(*keys, "person", "category").distinct()


def last_event_with(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Title, time and place of the latest event with each person; ties go to the smaller id."""
    entry = F.struct("title", "start", "location")
    rows = exploded_people(df).withColumn("_age", timebins.micros_between(F.col("start"), timebins.epoch()))
    latest = rows.groupBy(*keys, "person").agg(F.min_by(entry, F.struct("_age", "id")).alias("_last"))
    return latest.select(
        *keys,
        "person",
        F.col("_last")["title"].alias("last_event_title"),
        F.col("_last")["start"].alias("last_event_date"),
        F.col("_last")["location"].alias("last_event_location"),
    )


def people_overview(df: DataFrame, as_of: Column, min_total_events: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """The people table: time share, last-seen bucket, tenure and trend on one row."""
    share = social_time_share(df, keys)
    trend = fading_or_growing(df, min_total_events, keys).select(*keys, "person", "slope_events_per_year")
    days = timebins.last_seen_days(F.col("last_seen"), as_of)
    tenure = timebins.last_seen_days(F.col("first_seen"), as_of)
    return share.join(trend, [*keys, "person"], "left").withColumns(
        {
            "last_seen_days": days,
            "last_seen_bucket": timebins.last_seen_bucket(days),
            "tenure_days": tenure,
            "tenure": timebins.tenure_label(tenure),
            "trend_strength": timebins.trend_strength(F.col("slope_events_per_year")),
            "trend": F.when(
                F.col("slope_events_per_year").isNotNull(), timebins.trend_direction(F.col("slope_events_per_year"))
            ),
        }
    )
