"""The place dimension: location text to coordinates and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datelore.schema import GEO_FIELDS


def read_geo_json(spark: SparkSession, path) -> DataFrame:
    """A JSON object {location: entry or null}; a null entry keeps its row with null coordinates.

    One such file is one record. A place table that has outgrown it belongs in parquet.
    """
    entries = F.from_json("value", T.MapType(T.StringType(), GEO_FIELDS))
    rows = spark.read.text(path, wholetext=True).select(F.explode(entries).alias("location", "entry"))
    return rows.select("location", "entry.*")


def read_geo(spark: SparkSession, path, layout: str = "parquet") -> DataFrame:
    if layout == "json":
        return read_geo_json(spark, path)
    if layout == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"layout must be 'parquet' or 'json', got {layout!r}")


def has_coordinates(prefix: str = "") -> Column:
    return F.col(f"{prefix}lat").isNotNull() & F.col(f"{prefix}lon").isNotNull()


def _entry(df: DataFrame) -> Column:
    """All place fields of a row as one struct; fields the table lacks are null."""
    fields = [
        (F.col(field.name) if field.name in df.columns else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in GEO_FIELDS.fields
    ]
    return F.struct(*fields)


def effective_geo(cached: DataFrame, overrides: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cached places with manual corrections on top.

    A correction replaces the whole entry, and only when it has both coordinates.
    """
    on = [*keys, "location"]
    base = cached.select(*on, _entry(cached).alias("_cached"), F.lit(True).alias("_known"))
    fixed = overrides.filter(has_coordinates()).select(*on, _entry(overrides).alias("_fixed"))
    merged = base.join(fixed, on, "full")
    return merged.select(*on, F.coalesce("_fixed", "_cached").alias("_entry")).select(*on, "_entry.*")


def upsert_overrides(overrides: DataFrame, changes: DataFrame, keys: Sequence[str] = (), order: str = "changed_at") -> DataFrame:
    """Overrides after applying changes with numeric coordinates; the latest change of a place wins."""
    on = [*keys, "location"]
    valid = changes.filter(has_coordinates())
    latest = valid.groupBy(*on).agg(F.max_by(_entry(valid), F.col(order)).alias("_entry")).select(*on, "_entry.*")
    kept = overrides.join(latest.select(*on), on, "left_anti").select(*on, _entry(overrides).alias("_e")).select(*on, "_e.*")
    return kept.unionByName(latest)


def rejected_overrides(changes: DataFrame) -> DataFrame:
    """Changes that lack a coordinate, with the reason."""
    return changes.filter(~has_coordinates()).withColumn("error", F.lit("override needs numeric lat and lon"))


def clear_entries(dimension: DataFrame, locations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    on = [*keys, "location"]
    return dimension.join(locations.select(*on).distinct(), on, "left_anti")


def count_cleared(dimension: DataFrame, locations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many entries :func:`clear_entries` removes."""
    on = [*keys, "location"]
    found = dimension.join(locations.select(*on).distinct(), on, "left_semi")
    return found.groupBy(*keys).agg(F.count("*").alias("removed"))


def geocoded_count(dimension: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return dimension.groupBy(*keys).agg(F.count_if(has_coordinates()).alias("n_geocoded"))


def with_coordinates(df: DataFrame, geo: DataFrame, keys: Sequence[str] = (), fields=("lat", "lon"), how: str = "left") -> DataFrame:
    """Look places up by their exact text.

    Fields the table does not have are left out. The dimension grows with the data,
    so the join strategy is left to the optimizer's measured sizes. ``how="inner"`` keeps geocoded rows only.
    """
    on = [*keys, "location"]
    chosen = geo.filter(has_coordinates()) if how == "inner" else geo
    return df.join(chosen.select(*on, *[f for f in fields if f in geo.columns]), on, how)
