"""The table of calendar sources and the jobs that merge their events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.functions.text import none_if_empty, strip
from datelore.operators.dedupe import dedupe_events
from datelore.sources.events import normalize_events, with_raw_columns

# --- Fixed values ---
PROVIDERS = ["apple", "google", "outlook", "other"]
KINDS = ["ics_url", "ics_file", "events_json"]
FILE_KINDS = ["ics_file", "events_json"]
# --- end of fixed values ---


def source_error(provider: Column, kind: Column, url: Column, has_file: Column) -> Column:
    """Why a source cannot be registered; null when it can."""
    return (
        F.when(~F.coalesce(provider.isin(PROVIDERS), F.lit(False)), F.lit("unknown provider"))
        .when(~F.coalesce(kind.isin(KINDS), F.lit(False)), F.lit("unknown kind"))
        .when((kind == "ics_url") & none_if_empty(url).isNull(), F.lit("url is required"))
        .when(kind.isin(FILE_KINDS) & ~F.coalesce(has_file, F.lit(False)), F.lit("file is required"))
    )


def check_sources(requests: DataFrame) -> DataFrame:
    """Requests (source_id, name, provider, kind, url, has_file) with an ``error`` column."""
    return requests.withColumn(
        "error", source_error(F.col("provider"), F.col("kind"), F.col("url"), F.col("has_file"))
    )


def register_sources(sources: DataFrame, requests: DataFrame, added_at: Column) -> DataFrame:
    """Sources plus every valid request, visible and not synced yet."""
    added = (
        check_sources(requests)
        .filter(F.col("error").isNull())
        .withColumns({"visible": F.lit(True), "added_at": added_at.cast("timestamp_ntz"), "event_count": F.lit(0)})
        .drop("error", "has_file")
    )
    return sources.unionByName(added, allowMissingColumns=True)


def set_visibility(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (source_id, visible) changes; unknown ids change nothing."""
    wanted = changes.select("source_id", F.col("visible").alias("_visible"))
    return sources.join(wanted, "source_id", "left").withColumn("visible", F.coalesce("_visible", "visible")).drop("_visible")


def remove_sources(sources: DataFrame, removed: DataFrame) -> DataFrame:
    return sources.join(removed.select("source_id"), "source_id", "left_anti")


def sync_summary(sources: DataFrame, events: DataFrame, synced_at: Column, errors: DataFrame | None = None) -> DataFrame:
    """Sources after a sync: event counts and time for those that succeeded.

    ``errors`` (source_id, error) marks failed syncs; such a source keeps its
    row, its last count and its last sync time.
    """
    counted = events.groupBy("source_id").agg(F.count("*").alias("_events"))
    joined = sources.join(counted, "source_id", "left")
    if errors is None:
        failed = F.lit(None).cast("string")
    else:
        joined = joined.join(errors.select("source_id", F.col("error").alias("_error")), "source_id", "left")
        failed = F.col("_error")
    return joined.withColumns(
        {
            "event_count": F.when(failed.isNull(), F.coalesce("_events", F.lit(0))).otherwise(F.col("event_count")),
            "last_synced": F.when(failed.isNull(), synced_at.cast("timestamp_ntz")).otherwise(F.col("last_synced")),
            "last_sync_error": failed,
        }
    ).drop("_events", "_error")


def merged_source_events(sources: DataFrame, events: DataFrame) -> DataFrame:
    """Events of visible sources; a source without the flag counts as visible."""
    visible = sources.filter(F.coalesce("visible", F.lit(True))).select("source_id")
    return events.join(visible, "source_id", "left_semi")


def combine(
    primary: DataFrame, imported: DataFrame, sources: DataFrame, keys: Sequence[str] = (), order: str = "id"
) -> DataFrame:
    """The event table over the primary export and every visible source.

    Copies of one event keep the primary record.
    """
    first = with_raw_columns(primary).withColumn("priority", F.lit(0))
    others = with_raw_columns(merged_source_events(sources, imported)).withColumn("priority", F.lit(1))
    both = first.unionByName(others, allowMissingColumns=True)
    return normalize_events(dedupe_events(both, keys=keys, order=("priority", order)), keys)
