"""Link date-like events to the closest row of another table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.functions.timebins import MICROS_PER_DAY
from datelore.operators.filters import DATE_CATEGORIES, date_events
from datelore.operators.sequences import nearest


def link_to_external(
    df: DataFrame,
    external: DataFrame,
    categories: Sequence[str] = DATE_CATEGORIES,
    max_gap_days: float = 3.0,
    keys: Sequence[str] = (),
    order: Column | None = None,
) -> DataFrame:
    """Each date event with the external row of its partner that is closest in time.

    ``external`` has ``person``, ``timestamp`` and any other columns, which come back
    prefixed ``external_``. Names compare without case. ``order`` breaks ties
    between equally close rows (default: the timestamp). Adds ``gap_days``.
    """
    keys = list(keys)
    dates = date_events(df, categories).filter(F.coalesce("date_partner", F.lit("")) != "")
    left = dates.withColumn("_who", F.lower("date_partner"))
    moment = F.col("timestamp").cast("timestamp_ntz")
    right = external.withColumns({"_who": F.lower("person"), "timestamp": moment})
    matched = nearest(
        left, right, [*keys, "_who"], "start", "timestamp", F.col("timestamp") if order is None else order, max_gap_days
    )
    attached = [name for name in external.columns if name not in keys]
    return matched.select(
        *df.columns,
        "date_partner",
        *[F.col("match")[name].alias(f"external_{name}") for name in attached],
        (F.col("gap_micros") / F.lit(float(MICROS_PER_DAY))).alias("gap_days"),
    )
