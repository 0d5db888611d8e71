"""Time and money by category, and activity by month and season."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.functions.timebins import SEASONS
from datelore.operators.common import attach_per_key, fill_grid, mode_per_group, with_share
from datelore.operators.filters import in_category, timed_events

# --- Fixed values: cost of one visit ---
DEFAULT_COST_PER_VISIT = {"restaurant": 45, "bar": 25, "coffee": 8, "gym": 0}
# --- end of fixed values ---

Costs = Mapping[str, float] | DataFrame


def _hours_by_category(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    named = timed_events(df).filter(F.col("category").isNotNull())
    return named.groupBy(*keys, "category").agg(
        F.count("id").alias("events"), F.sum("duration_hours").alias("total_hours")
    )


def time_by_category(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Events, hours and share of hours per category; timed events only."""
    return with_share(_hours_by_category(df, keys), "total_hours", "share_of_hours", keys)


def _with_cost(df: DataFrame, costs: Costs, how: str) -> DataFrame:
    """Cost per visit by category, compared without case.

    A mapping is part of the program and becomes a literal; a table (category,
    cost_per_visit) of any size is joined.
    """
    if isinstance(costs, DataFrame):
        table = costs.select(F.lower("category").alias("_cost_key"), F.col("cost_per_visit").cast("double"))
        joined = df.withColumn("_cost_key", F.lower("category")).join(table, "_cost_key", how)
        return joined.drop("_cost_key")
    pairs = {name.lower(): float(cost) for name, cost in costs.items()}
    price: Column = F.lit(None).cast("double")
    if pairs:
        literal = F.create_map(*[F.lit(item) for pair in pairs.items() for item in pair])
        price = F.try_element_at(literal, F.lower("category"))
    priced = df.withColumn("cost_per_visit", price)
    return priced if how == "left" else priced.filter(F.col("cost_per_visit").isNotNull())


def estimated_spend_by_category(df: DataFrame, costs: Costs = DEFAULT_COST_PER_VISIT, keys: Sequence[str] = ()) -> DataFrame:
    """Time by category plus events x cost; null where no cost is known."""
    priced = _with_cost(time_by_category(df, keys), costs, "left")
    return priced.withColumn("estimated_spend", F.col("events") * F.col("cost_per_visit"))


def spend_by_year(df: DataFrame, costs: Costs = DEFAULT_COST_PER_VISIT, keys: Sequence[str] = ()) -> DataFrame:
    """Spend per year and priced category, 0 where a category had no visit that year."""
    visits = timed_events(df).groupBy(*keys, "year", "category").agg(F.count("*").alias("_visits"))
    priced = _with_cost(visits, costs, "inner").withColumn("spend", F.col("_visits") * F.col("cost_per_visit"))
    return fill_grid(priced.select(*keys, "year", "category", "spend"), keys, ["year"], "category", ["spend"])


def spend_by_year_table(
    df: DataFrame, categories: Sequence[str], costs: Costs = DEFAULT_COST_PER_VISIT, keys: Sequence[str] = ()
) -> DataFrame:
    """The same with one column for each of the given categories."""
    return spend_by_year(df, costs, keys).groupBy(*keys, "year").pivot("category", list(categories)).agg(F.sum("spend")).na.fill(0.0)


def _per_year_average(df: DataFrame, keys: Sequence[str], part: str, parts: Sequence, average: str) -> DataFrame:
    """Events per part of the year over the number of distinct years, every part present."""
    # Counting by (part, year) first lets one small table give both numerators and years.
    cells = df.groupBy(*keys, part, "year").agg(F.count("*").alias("_n"))
    counted = cells.groupBy(*keys).agg(
        F.greatest(F.count_distinct("year"), F.lit(1)).alias("_years"),
        *[F.sum(F.when(F.col(part) == value, F.col("_n"))).alias(f"_part_{value}") for value in parts],
    )
    entries = F.array(
        *[
            F.struct(F.lit(value).alias(part), F.coalesce(F.col(f"_part_{value}"), F.lit(0)).alias("_n"))
            for value in parts
        ]
    )
    spread = counted.select(*keys, "_years", F.inline(entries))
    return spread.select(*keys, part, (F.col("_n") / F.col("_years")).alias(average))


def monthly_activity(df: DataFrame, category: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    events = in_category(timed_events(df), category)
    return _per_year_average(events, keys, "month", range(1, 13), "avg_events_per_month")


def seasonal_activity(df: DataFrame, category: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    events = in_category(timed_events(df), category)
    return _per_year_average(events, keys, "season", SEASONS, "avg_events_per_season")


def category_seasonality(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Events per season and active year of each category, one column per season."""
    named = timed_events(df).filter(F.col("category").isNotNull())
    cells = named.groupBy(*keys, "category", "season", "year").agg(F.count("*").alias("_n"))
    years = F.count_distinct("year")
    return cells.groupBy(*keys, "category").agg(
        *[(F.coalesce(F.sum(F.when(F.col("season") == s, F.col("_n"))), F.lit(0)) / years).alias(s) for s in SEASONS]
    )


def category_colors(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent calendar colour per category; categories without a colour are absent."""
    colored = df.filter(F.col("calendar_color").isNotNull() & F.col("category").isNotNull())
    return mode_per_group(colored, [*keys, "category"], "calendar_color")


def summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals over the filtered events: events, hours, top category, distinct people."""
    by_category = df.groupBy(*keys, "category").agg(
        F.count("*").alias("_n"), F.sum("duration_hours").alias("_hours")
    )
    named = F.when(F.col("category").isNotNull(), F.struct(-F.col("_n"), F.col("category")))
    totals = by_category.groupBy(*keys).agg(
        F.sum("_n").alias("total_events"),
        F.coalesce(F.sum("_hours"), F.lit(0.0)).alias("total_hours"),
        F.min_by("category", named).alias("top_category"),
    )
    totals = totals.withColumn("total_events", F.coalesce("total_events", F.lit(0)))
    people = df.select(*keys, F.explode_outer("people").alias("_person"))
    counted = people.groupBy(*keys).agg(F.count_distinct("_person").alias("n_people"))
    return attach_per_key(totals, counted, keys)


def date_bounds(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("total_events"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
        F.to_date(F.min("start")).alias("min_date"),
        F.to_date(F.max("start")).alias("max_date"),
    )


def categories_by_events(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    named = df.filter(F.col("category").isNotNull())
    return named.groupBy(*keys, "category").agg(F.count("*").alias("events"))


def distinct_people(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, F.explode("people").alias("person")).distinct()


def distinct_locations(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col("location").isNotNull()).select(*keys, "location").distinct()
