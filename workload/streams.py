"""Streaming jobs run to the end of the data they find; their sink table is the result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from datelore.session import ensure_checkpoint_dir
from datelore.sources import tables as t
from datelore.streaming import calendars, jobs
from workload.registry import query
from workload.sql import EVT, day, n, r, ts
from workload.trips import STAY_COLUMNS, STAYS


def drained(spark, stream):
    """Everything an append-mode stream emits, from a table in the shared folder."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def event_stream(spark, folder):
    reader = spark.readStream.schema(t.table(spark, folder, "events").schema).option("pathGlobFilter", "events.parquet")
    return t.event_calendar_rows(reader.parquet(folder))


@query(
    "stream_weekly_load",
    f"""WITH {EVT}, w AS (SELECT owner_id, week, sum(duration_hours) AS h, count(*) AS c FROM evt WHERE NOT is_all_day GROUP BY ALL)
    SELECT owner_id, {day('week')} AS week, {r('h')} AS total_hours, {n('c')} AS event_count FROM w
    WHERE CAST(week + 1 AS TIMESTAMP) <= (SELECT max("start") FROM evt WHERE NOT is_all_day) - INTERVAL 1 DAY""",
)
def stream_weekly_load(spark, folder):
    return drained(spark, jobs.weekly_load_stream(event_stream(spark, folder), "1 day", ["owner_id"]))


@query(
    "stream_dedupe",
    f"""WITH {EVT} SELECT owner_id, lower(title) AS title, count(DISTINCT "start") AS events FROM evt GROUP BY ALL""",
)
def stream_dedupe(spark, folder):
    rows = event_stream(spark, folder)
    rows = rows.withColumns({"startDate": F.col("start").cast("string"), "endDate": F.col("end").cast("string")})
    kept = drained(spark, jobs.dedupe_stream(rows, "40 days", ["owner_id"]))
    return kept.groupBy("owner_id", F.lower("title").alias("title")).agg(F.count("*").alias("events"))


# Events up to the final watermark are merged; the last trip of a user is emitted once its gap has passed.
@query(
    "stream_trips",
    f"""WITH {EVT}, clicks AS (SELECT *, coalesce(location, title) AS place FROM evt WHERE category IN ('click', 'view')),
    wm AS (SELECT date_trunc('millisecond', max("start")) - INTERVAL 1 DAY AS w FROM clicks),
    trav AS (SELECT * FROM clicks WHERE "start" <= (SELECT w FROM wm)),
    {STAYS.format(src='trav', gap=1, k='owner_id, ', by='PARTITION BY owner_id')},
    last_one AS (SELECT *, lead("start") OVER (PARTITION BY owner_id ORDER BY "start", "end") AS following FROM stays)
    SELECT owner_id, place AS destination, {STAY_COLUMNS} FROM last_one WHERE following IS NOT NULL OR (SELECT w FROM wm) - "end" > INTERVAL 1 DAY""",
)
def stream_trips(spark, folder):
    return drained(spark, jobs.trips_stream(event_stream(spark, folder), ["owner_id"], ["click", "view"], 1, "1 day"))


def latest(spark, stream, on):
    """The last state of every row that an update-mode stream emits, those still open included."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def land(batch, number):
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/table/landed={number}")

    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{base}/state")
    writer.outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rest = [name for name in stream.columns if name not in on]
    landed = spark.read.parquet(f"{base}/table")
    newest = landed.groupBy(*on).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return newest.select(*on, "_row.*")


@query(
    "stream_weeks_so_far",
    f"""WITH {EVT} SELECT owner_id, {day('week')} AS week, {r('sum(duration_hours)')} AS total_hours, count(*) AS event_count
    FROM evt WHERE NOT is_all_day GROUP BY owner_id, week""",
)
def stream_weeks_so_far(spark, folder):
    return latest(spark, jobs.weekly_load_stream(event_stream(spark, folder), "40 days", ["owner_id"]), ["owner_id", "week"])


@query(
    "stream_people",
    f"""WITH {EVT} SELECT owner_id, person, count(*) AS events, {r('sum(duration_hours)')} AS total_hours, {ts('min("start")')} AS first_seen,
    {ts('max("start")')} AS last_seen FROM (SELECT *, unnest(people) AS person FROM evt WHERE NOT is_all_day) GROUP BY owner_id, person""",
)
def stream_people(spark, folder):
    return latest(spark, jobs.person_frequency_stream(event_stream(spark, folder), ["owner_id"]), ["owner_id", "person"])


@query(
    "stream_enrichment",
    f"""WITH {EVT}, place AS (SELECT 'Place ' || p_partkey AS location, 40.0 + p_partkey AS lat, 0.5 * p_partkey AS lon, p_brand AS city FROM part WHERE p_partkey % 3 <> 0)
    SELECT owner_id, id, evt.location, {r('lat')} AS lat, {r('lon')} AS lon, city FROM evt LEFT JOIN place ON place.location = evt.location""",
)
def stream_enrichment(spark, folder):
    key = F.col("p_partkey")
    places = t.table(spark, folder, "part").filter(key % 3 != 0).select(
        F.concat(F.lit("Place "), key.cast("string")).alias("location"), (key + 40.0).alias("lat"), (key * 0.5).alias("lon"), F.col("p_brand").alias("city")
    )
    rows = event_stream(spark, folder).select("owner_id", "id", "location")
    return drained(spark, jobs.enrich_stream(rows, places)).select("owner_id", "id", "location", "lat", "lon", "city")


# Two versions of each nation's orders, the second of the even nations only; nation 1 then sends no calendar and nation 3 an empty one.
_VERSIONS = """v AS (SELECT CAST(c_nationkey AS VARCHAR) AS source_id, c_nationkey AS nk, o_orderkey AS k, o_orderdate AS d FROM orders JOIN customer ON o_custkey = c_custkey),
    first_ AS (SELECT source_id, nk, source_id || ':s' || k AS id, 'Order ' || k AS title, d FROM v WHERE k % 3 <> 0),
    second_ AS (SELECT source_id, nk, source_id || ':s' || k AS id, CASE WHEN k % 5 = 0 THEN 'Changed ' ELSE 'Order ' END || k AS title, d FROM v WHERE k % 4 <> 0 AND nk % 2 = 0)"""


def _landed_versions(spark, folder):
    """Versions of calendars land one after another, each drained by the same stream."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/sources-{uuid.uuid4().hex}"
    orders = t.table(spark, folder, "orders").join(t.table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    changed = F.when(key % 5 == 0, F.lit("Changed ")).otherwise(F.lit("Order "))
    versions = [
        (orders.filter(key % 3 != 0), F.lit("Order ")),
        (orders.filter((key % 4 != 0) & (F.col("c_nationkey") % 2 == 0)), changed),
        (None, None),
    ]
    for number, (rows, title) in enumerate(versions):
        if rows is None:
            text = F.when(F.col("id") == 1, F.lit("<html>not found</html>")).otherwise(F.lit("BEGIN:VCALENDAR\nEND:VCALENDAR"))
            files = spark.range(1, 4, 2).select(F.col("id").alias("source"), F.lit(0).alias("line"), text.alias("value"))
        else:
            start = F.date_format("o_orderdate", "yyyyMMdd'T'000000'Z'")
            lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:s"), key), F.concat(F.lit("SUMMARY:"), title, key), F.concat(F.lit("DTSTART:"), start), F.lit("END:VEVENT")]
            files = rows.select(F.col("c_nationkey").alias("source"), F.lit(1).alias("line"), F.concat_ws("\r\n", *lines).alias("value"))
            files = files.unionByName(files.select("source").distinct().withColumns({"line": F.lit(0), "value": F.lit("BEGIN:VCALENDAR")}))
        dealt = files.repartition("source").sortWithinPartitions("source", "line").withColumn("version", F.lit(f"v{number}"))
        dealt.drop("line").write.mode("append").partitionBy("source", "version").text(f"{base}/sources")
        calendars.land_ics(calendars.stream_ics(spark, f"{base}/sources"), f"{base}/table", f"{base}/state").awaitTermination()
    return f"{base}/table"


@query(
    "stream_ics",
    f"""WITH {_VERSIONS} SELECT source_id, id, title, strftime(d, '%Y-%m-%dT%H:%M:%SZ') AS start_text
    FROM (SELECT * FROM first_ WHERE nk % 2 <> 0 AND nk <> 3 UNION ALL SELECT * FROM second_)""",
)
def stream_ics(spark, folder):
    found = calendars.landed_ics(spark, _landed_versions(spark, folder))
    return found.select("source_id", "id", "title", F.col("startDate").alias("start_text"))


@query(
    "stream_ics_log",
    f"""WITH {_VERSIONS},
    a AS (SELECT source_id, count(*) AS c FROM first_ GROUP BY 1),
    b AS (SELECT s.source_id, count(*) AS c, count(*) FILTER (WHERE f.id IS NULL) AS added, count(*) FILTER (WHERE f.title <> s.title) AS changed
      FROM second_ s LEFT JOIN first_ f USING (source_id, id) GROUP BY 1),
    gone AS (SELECT f.source_id, count(*) AS c FROM first_ f LEFT JOIN second_ s USING (source_id, id) WHERE f.nk % 2 = 0 AND s.id IS NULL GROUP BY 1)
    SELECT source_id, 'v0' AS version, c AS event_count, c AS added, 0 AS changed, 0 AS removed, CAST(NULL AS VARCHAR) AS last_sync_error FROM a
    UNION ALL SELECT b.source_id, 'v1', b.c, added, changed, coalesce(gone.c, 0), NULL FROM b LEFT JOIN gone USING (source_id)
    UNION ALL SELECT '1', 'v2', NULL, NULL, NULL, NULL, 'no calendar in the file'
    UNION ALL SELECT '3', 'v2', 0, 0, 0, c, NULL FROM a WHERE source_id = '3'""",
)
def stream_ics_log(spark, folder):
    return calendars.sync_log(spark, _landed_versions(spark, folder)).drop("epoch")
