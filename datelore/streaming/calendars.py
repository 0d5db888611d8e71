"""Streaming ingest of iCalendar sources: a new version of a source replaces the events of the one before.

Versions land as files ``<folder>/<source>/<version>/<any>.ics``; all files of one version come
together (write them elsewhere and move the folder in). The table has one folder of events and one of log rows for each micro-batch,
and nothing in it is ever changed: the events of a source are those of its last good version. So a
batch that is run again writes what it wrote before, and readers never see half a replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from datelore.operators.common import reading_all
from datelore.schema import RAW_EVENT
from datelore.sources.ics import parse_ics, raw_records

#: Source and version in a path; ``name=`` before either is left out.
PLACE = r"/(?:[^/=]*=)?([^/]+)/(?:[^/=]*=)?([^/]+)/[^/]+$"
LOG = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("source_id", "version")]
    + [T.StructField(c, T.LongType()) for c in ("event_count", "added", "changed", "removed")]
    + [T.StructField("last_sync_error", T.StringType()), T.StructField("epoch", T.LongType())]
)
EVENTS = T.StructType([*RAW_EVENT.fields, T.StructField("source_id", T.StringType()), T.StructField("epoch", T.LongType())])


def _place(file: Column, group: int) -> Column:
    return F.url_decode(F.regexp_extract(file, PLACE, group))


def stream_ics(spark: SparkSession, folder: str) -> DataFrame:
    """New iCalendar files of a folder as text records, for ``land_ics``."""
    return raw_records(spark.readStream.option("recursiveFileLookup", "true"), folder)


def _read(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """What earlier batches wrote; nothing where there is no table yet."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(path)
    return found if before is None else found.filter(F.col("epoch") < before)


def _current(events: DataFrame, log: DataFrame) -> DataFrame:
    """Events of each source's last version without error."""
    last = log.filter("last_sync_error is null").groupBy("source_id").agg(F.max("epoch").alias("epoch"))
    return events.join(last, ["source_id", "epoch"], "left_semi")


def _newest(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of the last version of each source in ``raw``, and these versions with whether there is a calendar in them."""
    # One row for each file, so that paths are taken apart once; there are no more than the batch has listed.
    files = reading_all(raw.filter("file is not null").groupBy("file").agg(F.max(F.contains("value", F.lit("BEGIN:VCALENDAR"))).alias("good")))
    placed = files.withColumns({"source_id": _place(F.col("file"), 1), "version": _place(F.col("file"), 2)})
    versions = placed.groupBy("source_id").agg(F.max("version").alias("version"))
    newest = placed.join(versions, ["source_id", "version"], "left_semi")
    sources = newest.groupBy("source_id", "version").agg(F.max("good").alias("good"))
    # Broadcast, because a shuffle of the records would cost as much as reading them, and they stay in their order.
    kept = raw.join(F.broadcast(newest.select("file")), "file", "left_semi")
    name = _place(F.col("file"), 1)
    events = parse_ics(kept.select("value", "file", "block"), name, name).select(*RAW_EVENT.fieldNames(), "source_id")
    return events, sources


def _logged(spark: SparkSession, events: DataFrame, sources: DataFrame, table: str, epoch: int) -> DataFrame:
    """Log rows of the versions ``sources``, whose ``events`` are held against what earlier batches wrote."""

    def told(df: DataFrame) -> DataFrame:
        content = F.xxhash64(*[F.col(c) for c in RAW_EVENT.fieldNames() if c != "noteTags"]).cast("decimal(20,0)")
        return df.groupBy("source_id", "id").agg(F.sum(content).alias("content"), F.count("*").alias("copies"))

    before = _current(_read(spark, f"{table}/events", EVENTS, epoch), _read(spark, f"{table}/log", LOG, epoch))
    new = told(events).withColumnsRenamed({"content": "new", "copies": "new_copies"})
    old = told(before.join(sources.select("source_id"), "source_id", "left_semi")).select("source_id", "id", F.col("content").alias("old"))
    counts = new.join(old, ["source_id", "id"], "full_outer").groupBy("source_id").agg(
        F.count(F.when(F.col("old").isNull(), 1)).alias("added"),
        F.count(F.when(F.col("old") != F.col("new"), 1)).alias("changed"),
        F.count(F.when(F.col("new").isNull(), 1)).alias("removed"),
        F.sum("new_copies").alias("event_count"),
    )
    known = sources.join(counts, "source_id", "left")
    zero = F.lit(0).cast("long")
    return known.select(
        "source_id",
        "version",
        *[F.when(F.col("good"), F.coalesce(c, zero)).alias(c) for c in ("event_count", "added", "changed", "removed")],
        F.when(~F.col("good"), F.lit("no calendar in the file")).alias("last_sync_error"),
    )


def replaced(spark: SparkSession, raw: DataFrame, table: str, epoch: int) -> tuple[DataFrame, DataFrame]:
    """Events and log rows of the sources whose files are in ``raw``, as batch ``epoch`` of the table.

    Of several versions of a source in one batch the last by name counts. A version without
    a calendar is logged as an error and leaves the source as it was; one with a calendar and no events
    empties it. Events are compared by id and content; copies of one id count as one event, whatever their order.
    """
    events, sources = _newest(raw)
    return events, _logged(spark, events, sources, table, epoch)


def land_ics(records: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Run the stream over the files that are there; each micro-batch replaces the sources it brings."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        events, sources = _newest(batch)
        # Files are parsed once: the log compares what was written. Log rows make a version count, so they come last.
        path = f"{table}/events/epoch={epoch}"
        events.write.mode("overwrite").parquet(path)
        log = _logged(spark, spark.read.schema(events.schema).parquet(path), sources, table, epoch)
        log.write.mode("overwrite").parquet(f"{table}/log/epoch={epoch}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed_ics(spark: SparkSession, table: str) -> DataFrame:
    """The events of all sources as of their last good version."""
    return _current(_read(spark, f"{table}/events", EVENTS), _read(spark, f"{table}/log", LOG)).drop("epoch")


def sync_log(spark: SparkSession, table: str) -> DataFrame:
    """One row for each version that came: events, and how many were added, changed and removed, or the error."""
    return _read(spark, f"{table}/log", LOG)
