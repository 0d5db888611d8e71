"""Building blocks shared by the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reading_all(df: DataFrame) -> DataFrame:
    """The same rows, with every column needed.

    A second aggregate over ``df`` would be planned with fewer columns and so run the
    scan again. A condition over all columns that holds for every row keeps both
    uses alike, and Spark shuffles the input once and reuses it.
    """
    return df.filter(F.xxhash64(*df.columns) >= F.lit(-(2**63)))


def attach_per_key(df: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of ``per_key`` (one row per calendar) to every row.

    Without keys ``per_key`` is a single row and is read as a scalar subquery.
    """
    if keys:
        return df.join(per_key, list(keys), "inner")
    names = per_key.columns
    row = per_key.select(F.struct(*names).alias("_row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, *[F.col("_row")[name].alias(name) for name in names])


def with_share(df: DataFrame, value: str, share: str, keys: Sequence[str] = ()) -> DataFrame:
    """``value`` over its total per calendar; null when the total is zero.

    The total is an aggregate of its own, so no window has to hold a calendar.
    """
    total = reading_all(df).groupBy(*keys).agg(F.sum(value).alias("_total"))
    joined = attach_per_key(df, total, keys)
    return joined.withColumn(share, F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def top_value(counted: DataFrame, group: Sequence[str], value: str, count: str, alias: str | None = None) -> DataFrame:
    """Most frequent value per group from pre-aggregated counts; ties go to the smallest value."""
    return counted.groupBy(*group).agg(
        F.min_by(value, F.struct(-F.col(count), F.col(value))).alias(alias or value)
    )


def mode_per_group(df: DataFrame, group: Sequence[str], value: str, alias: str | None = None) -> DataFrame:
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    return top_value(counted, group, value, "_n", alias)


def fill_grid(
    counted: DataFrame, keys: Sequence[str], rows: Sequence[str], axis: str, values: Sequence[str], wanted: DataFrame | None = None
) -> DataFrame:
    """Every row group crossed with every axis value its calendar has, missing cells 0.

    ``counted`` has one row per (keys, rows, axis). The axis is a set of calendar
    periods or categories, short enough to travel as one array per calendar. Only the
    row groups of ``wanted`` (keys, rows) are filled when it is given, over the axis of all.
    """
    keys, rows = list(keys), list(rows)
    axes = reading_all(counted).groupBy(*keys).agg(F.sort_array(F.collect_set(axis)).alias("_axis"))
    filled = counted if wanted is None else counted.join(wanted, [*keys, *rows], "left_semi")
    cells = filled.groupBy(*keys, *rows).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(axis), F.struct(*values)))).alias("_cells")
    )
    grid = attach_per_key(cells, axes, keys).select(*keys, *rows, "_cells", F.explode("_axis").alias(axis))
    return grid.select(*keys, *rows, axis, *_cell_values(counted, axis, values))


def fill_weeks(weekly: DataFrame, group: Sequence[str], week: str, values: Sequence[str], bounds: DataFrame | None = None, bound_keys: Sequence[str] = ()) -> DataFrame:
    """Weekly rows with every missing week between first and last added as 0.

    The range is each group's own, or the calendar-wide one in ``bounds``
    (first_week, last_week per ``bound_keys``). A group is at most one row per
    week of its calendar, whatever the number of events.
    """
    cells = weekly.groupBy(*group).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(week), F.struct(*values)))).alias("_cells"),
        F.min(week).alias("_first"),
        F.max(week).alias("_last"),
    )
    cells = cells.filter(F.col("_first").isNotNull())
    first, last = F.col("_first"), F.col("_last")
    if bounds is not None:
        cells = attach_per_key(cells, bounds, bound_keys)
        first, last = F.col("first_week"), F.col("last_week")
    weeks = F.sequence(first, last, F.expr("interval 7 days"))
    spread = cells.select(*group, "_cells", F.explode(weeks).alias(week))
    return spread.select(*group, week, *_cell_values(weekly, week, values))


def _cell_values(source: DataFrame, axis: str, values: Sequence[str]) -> list[Column]:
    cell = F.try_element_at(F.col("_cells"), F.col(axis))
    return [F.coalesce(cell[name], F.lit(0).cast(source.schema[name].dataType)).alias(name) for name in values]


def weighted_quantiles(
    values: DataFrame, group: Sequence[str], value: str, weight: str, probabilities: dict[str, float], bucket: Column
) -> DataFrame:
    """Exact, linearly interpolated quantiles from (group, value, weight) rows.

    ``bucket`` is a coarse, non-decreasing function of the value. Ranks are found on
    the bucket totals first and then only inside the buckets that hold them, so a
    group of any size is spread over many tasks. ``probabilities`` maps output
    column to probability.
    """
    group = list(group)
    binned = values.withColumn("_bucket", bucket)
    # Stated once here, so that the join below does not add it to one use of the input only.
    for name in [*group, "_bucket"]:
        binned = binned.filter(F.col(name).isNotNull())
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        binned.groupBy(*group, "_bucket")
        .agg(F.sum(weight).alias("_in_bucket"))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_in_bucket").over(earlier), F.lit(0)),
                "_total": F.sum("_in_bucket").over(Window.partitionBy(*group)),
            }
        )
    )

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    def low(p: float) -> Column:
        return F.floor(position(p))

    def high(p: float) -> Column:
        return F.ceil(position(p))

    after = F.col("_before") + F.col("_in_bucket")
    wanted = F.lit(False)
    for p in probabilities.values():
        for rank in (low(p), high(p)):
            wanted = wanted | ((rank >= F.col("_before")) & (rank < after))
    candidates = binned.join(totals.filter(wanted), [*group, "_bucket"])
    running = Window.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = candidates.withColumn("_seen", F.col("_before") + F.sum(weight).over(running))
    bounds = [F.max("_total").alias("_total")]
    for name, p in probabilities.items():
        bounds.append(F.min(F.when(F.col("_seen") > low(p), F.col(value))).alias(f"_low_{name}"))
        bounds.append(F.min(F.when(F.col("_seen") > high(p), F.col(value))).alias(f"_high_{name}"))
    found = ranked.groupBy(*group).agg(*bounds)
    interpolated = [
        (
            F.col(f"_low_{name}")
            + (position(p) - low(p)) * (F.col(f"_high_{name}") - F.col(f"_low_{name}"))
        ).cast("double").alias(name)
        for name, p in probabilities.items()
    ]
    return found.select(*group, *interpolated)


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; tasks keep only their own first n before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n)


def limit_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Top-n report: ordered limit for one calendar, rank filter for many."""
    if keys:
        return top_n_per_group(df, keys, order, n, "_rank").drop("_rank")
    return df.orderBy(*order).limit(n)
