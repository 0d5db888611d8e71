"""Order-dependent operators that never hold a whole calendar in one task.

A window over all events of a calendar would put a hot calendar into one task, and a window
per hour a crowded midnight. The operators here are prefix scans: rows are dealt to ranges of
their whole order, each range is folded into a small carry, the carries of a calendar (one for each
range it reaches) are scanned, and each range takes up the carry before it. A range holds
about an even share of all rows, whichever calendar, hour or moment they belong to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelore.functions.timebins import MICROS_PER_DAY, micros_between
from datelore.operators.common import reading_all
from datelore.session import ensure_checkpoint_dir

#: Number of the range a row lies in; ranges are numbered in order.
SLICE = "_slice"


def runs(series: DataFrame, group: Sequence[str], order: str, state: str) -> DataFrame:
    """Maximal runs of equal state in an ordered, gap-free series: start, end, length, state.

    For weekly series, which are short per group.
    """
    ordered = Window.partitionBy(*group).orderBy(order)
    changed = F.coalesce(~F.col(state).eqNullSafe(F.lag(state).over(ordered)), F.lit(True))
    first = F.lag(order).over(ordered).isNull()
    numbered = series.withColumn("_start", (first | changed).cast("int")).withColumn(
        "_run", F.sum("_start").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(*group, "_run", state).agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("weeks")
    ).drop("_run")


def hour_of(ts: Column) -> Column:
    """Number of the hour a timestamp lies in; hours order like their timestamps."""
    return F.unix_date(F.to_date(ts)) * 24 + F.hour(ts)


def in_slices(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``rows`` with ``_slice``, the number of the range of ``order`` they were dealt to.

    Ranges follow each other in ``order`` and hold about the same number of rows each (ranges are
    cut by a sample of the rows); rows equal in ``order`` are told apart by their place in
    the input, so that any number of them spreads over many ranges. The rows are checkpointed, because
    other tasks rely on the cuts, which would be drawn anew if they were computed again.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    told = rows.withColumn("_place", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(*order, "_place").drop("_place")
    return dealt.withColumn(SLICE, F.spark_partition_id()).checkpoint()


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """``rows`` with ``name``, the place of each row in its calendar's ``order``, from 1.

    Rows are numbered inside their range, and the counts of the ranges before it are added; no
    calendar is numbered in one task. Rows equal in ``order`` get different places.
    """
    keys = list(keys)
    sliced = in_slices(rows, [*keys, *order])
    sizes = sliced.groupBy(*keys, SLICE).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, SLICE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*order))
    met = sliced.withColumn("_inside", inside).join(before, [*keys, SLICE])
    return met.withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside", SLICE)


def stays(events: DataFrame, keys: Sequence[str], place: str, gap_days: float, tie: str = "id") -> DataFrame:
    """Consecutive events at one place merged into stays.

    An event continues the stay when the event just before it (by start) was at
    the same place and it starts no later than ``gap_days`` after the latest end
    so far. Output: keys, place, start, end, n_events, duration_days.
    """
    keys = list(keys)
    gap = F.lit(int(gap_days * MICROS_PER_DAY))
    rows = in_slices(events.select(*keys, place, F.col("start"), F.col("end"), tie), [*keys, "start", tie])
    in_slice = Window.partitionBy(*keys, SLICE).orderBy("start", tie)
    so_far = in_slice.rowsBetween(Window.unboundedPreceding, 0)

    # Fold: place changes inside a range; the first event of a range waits for the carry.
    previous = F.lag(F.struct(place)).over(in_slice)
    marked = rows.withColumn(
        "_change", (previous.isNotNull() & ~F.col(place).eqNullSafe(previous[place])).cast("int")
    ).withColumn("_changes", F.sum("_change").over(so_far))
    # Events of a range at one place that lie closer than the gap collapse to one piece.
    at_place = Window.partitionBy(*keys, SLICE, "_changes").orderBy("start", tie)
    latest = F.max("end").over(at_place.rowsBetween(Window.unboundedPreceding, -1))
    pieces = (
        marked.withColumn("_break", (micros_between(latest, F.col("start")) > gap).cast("int"))
        .withColumn("_piece", F.sum(F.coalesce("_break", F.lit(0))).over(at_place.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, SLICE, "_changes", "_piece")
        .agg(
            F.first(place).alias(place),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.count("*").alias("n_events"),
        )
    )

    # Scan: one row per range tells whether it opens with a change and how many came before.
    carries = (
        reading_all(pieces)
        .groupBy(*keys, SLICE)
        .agg(
            F.max("_changes").alias("_in_slice"),
            F.min_by(F.struct(place), F.struct("_changes", "_piece")).alias("_first"),
            F.max_by(F.struct(place), F.struct("_changes", "_piece")).alias("_last"),
        )
    )
    over_slices = Window.partitionBy(*keys).orderBy(SLICE)
    before = F.lag("_last").over(over_slices)
    carries = carries.withColumn("_opens", (before.isNull() | ~F.col("_first").eqNullSafe(before)).cast("int"))
    carries = carries.withColumn(
        "_base",
        F.coalesce(
            F.sum(F.col("_in_slice") + F.col("_opens")).over(over_slices.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        )
        + F.col("_opens"),
    )
    # Apply: the pieces stay where the fold put them, so only the carries move for this join.
    pieces = pieces.join(carries.select(*keys, SLICE, "_base"), [*keys, SLICE]).withColumn(
        "_island", F.col("_base") + F.col("_changes")
    )

    # Stays: the same rule over the pieces of an island, one for each range and gap.
    over_pieces = Window.partitionBy(*keys, "_island").orderBy(SLICE, "_piece")
    latest = F.max("end").over(over_pieces.rowsBetween(Window.unboundedPreceding, -1))
    return (
        pieces.withColumn("_break", (micros_between(latest, F.col("start")) > gap).cast("int"))
        .withColumn("_stay", F.sum(F.coalesce("_break", F.lit(0))).over(over_pieces.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_island", "_stay")
        .agg(
            F.first(place).alias(place),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("n_events").alias("n_events"),
        )
        .select(
            *keys,
            place,
            "start",
            "end",
            "n_events",
            (micros_between(F.col("start"), F.col("end")) / F.lit(float(MICROS_PER_DAY))).alias("duration_days"),
        )
    )


def gap_counts(events: DataFrame, group: Sequence[str], ts: str = "start") -> DataFrame:
    """Gaps between consecutive events of a group: (group, gap_micros, n).

    Events at one moment are counted before the shuffle; all but one of them add a
    gap of 0. Gaps inside an hour come from a window per hour, gaps across hours from
    the first and last event of each.
    """
    group = list(group)
    moments = events.groupBy(*group, ts).agg(F.count("*").alias("_n")).withColumn("_hour", hour_of(F.col(ts)))
    in_hour = Window.partitionBy(*group, "_hour").orderBy(ts)
    inside = moments.select(
        *group, "_hour", ts, "_n", micros_between(F.lag(ts).over(in_hour), F.col(ts)).alias("gap_micros")
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("gap_micros"), (F.col("_n") - 1).alias("n"))
    one = F.struct("gap_micros", F.lit(1).cast("bigint").alias("n"))
    within = inside.select(*group, F.inline(F.array(zero, one)))
    hours = reading_all(inside).groupBy(*group, "_hour").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    over_hours = Window.partitionBy(*group).orderBy("_hour")
    across = hours.select(
        *group,
        micros_between(F.lag("_last").over(over_hours), F.col("_first")).alias("gap_micros"),
        F.lit(1).cast("bigint").alias("n"),
    )
    return (
        within.unionByName(across)
        .filter(F.col("gap_micros").isNotNull() & (F.col("n") > 0))
        .groupBy(*group, "gap_micros")
        .agg(F.sum("n").alias("n"))
    )


def nearest(
    left: DataFrame, right: DataFrame, group: Sequence[str], left_ts: str, right_ts: str, order: Column, max_gap_days: float
) -> DataFrame:
    """For each left row the right row of its group that is closest in time, either side.

    Ties go to the smaller ``order`` of the right table. Rows of both tables are
    merged by time and each left row looks at its nearest neighbour before and
    after it, so no pairs are formed. The match is the struct ``match``; rows
    without one inside the limit are dropped. Adds ``gap_micros``.
    """
    group = list(group)
    payload = [name for name in right.columns if name not in group]
    keyed = right.withColumn("_order", order)
    entry = F.struct(F.col(right_ts).alias("ts"), F.col("_order").alias("order"), F.struct(*payload).alias("row"))
    # Right rows at one moment compete only by order.
    single = keyed.groupBy(*group, F.col(right_ts).alias("_ts")).agg(F.min_by(entry, F.col("_order")).alias("_right"))
    own = [name for name in left.columns if name not in group]
    lefts = left.select(*group, F.col(left_ts).alias("_ts"), F.struct(*own).alias("_left"), F.lit(1).alias("_kind"))
    merged = single.withColumn("_kind", F.lit(0)).unionByName(lefts, allowMissingColumns=True)
    both = in_slices(merged, [*group, "_ts", "_kind"])
    part = Window.partitionBy(*group, SLICE)
    running = (Window.unboundedPreceding, Window.currentRow)
    windowed = both.withColumns(
        {
            "_prev": F.last("_right", ignorenulls=True).over(part.orderBy("_ts", "_kind").rowsBetween(*running)),
            "_next": F.last("_right", ignorenulls=True).over(
                part.orderBy(F.col("_ts").desc(), "_kind").rowsBetween(*running)
            ),
        }
    )
    seen = windowed.filter(F.col("_kind") == 1)
    # One carry per range: the first moment's next and the last moment's previous right row.
    moment = F.struct("_ts", "_kind")
    carries = reading_all(windowed).groupBy(*group, SLICE).agg(
        F.min_by("_next", moment).alias("_first"), F.max_by("_prev", moment).alias("_last")
    )
    across = Window.partitionBy(*group)
    earlier = across.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    later = across.orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = carries.select(
        *group,
        SLICE,
        F.last("_last", ignorenulls=True).over(earlier).alias("_carry_prev"),
        F.last("_first", ignorenulls=True).over(later).alias("_carry_next"),
    )
    joined = seen.join(carried, [*group, SLICE]).withColumns(
        {"_prev": F.coalesce("_prev", "_carry_prev"), "_next": F.coalesce("_next", "_carry_next")}
    )

    def candidate(side: str) -> Column:
        gap = F.abs(micros_between(F.col("_ts"), F.col(side)["ts"]))
        return F.when(F.col(side).isNotNull(), F.struct(gap.alias("gap"), F.col(side)["order"].alias("order"), F.col(side)["row"].alias("row")))

    chosen = joined.withColumns({"_a": candidate("_prev"), "_b": candidate("_next")}).withColumn(
        "_best",
        F.when(F.col("_b").isNull(), F.col("_a"))
        .when(F.col("_a").isNull(), F.col("_b"))
        .when(F.col("_a")["gap"] < F.col("_b")["gap"], F.col("_a"))
        .when(F.col("_a")["gap"] > F.col("_b")["gap"], F.col("_b"))
        .when(F.col("_a")["order"] <= F.col("_b")["order"], F.col("_a"))
        .otherwise(F.col("_b")),
    )
    limit = F.lit(int(max_gap_days * MICROS_PER_DAY))
    return chosen.filter(F.col("_best")["gap"] <= limit).select(
        *group, "_left.*", F.col("_best")["row"].alias("match"), F.col("_best")["gap"].alias("gap_micros")
    )
