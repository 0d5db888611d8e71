from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from datelore.functions import geo as geo_fn
from datelore.functions import text, timebins
from datelore.operators import dedupe, filters
from datelore.sources import events as ev
from datelore.session import ensure_checkpoint_dir
from datelore.sources import geo as geo_src
from datelore.sources import ics, manifest, records
from datelore.sources import tables as t
from workload.registry import query
from workload.sql import CAL, EVT, GEO, day, joined, n, r, ts

# Raw records made from orders.
RAW = """raw0 AS (SELECT *, 'Ana' || chr(CAST(97 + o_custkey % 13 AS INTEGER)) AS fn, 'Bo' || chr(CAST(97 + o_orderkey % 5 AS INTEGER)) AS second,
      o_orderdate + to_hours(o_orderkey % 24) AS st, o_orderkey % 6 AS six, o_orderkey % 8 AS eight FROM orders JOIN customer ON o_custkey = c_custkey),
    raw1 AS (SELECT *, fn || ' L' || chr(CAST(97 + (o_custkey + o_orderkey % 3) % 7 AS INTEGER)) || 'e' AS fulln FROM raw0),
    raw AS (SELECT CAST(c_nationkey AS BIGINT) AS owner_id, CAST(o_orderkey AS VARCHAR) AS id,
      CASE six WHEN 0 THEN 'Dinner with ' || fulln WHEN 1 THEN 'Game night with ' || fn || ', ' || second || ', and the twins'
        WHEN 2 THEN 'Lunch With ' || fn || ' and ' || fulln || ' 🎉!' WHEN 3 THEN 'Standup with the whole team'
        WHEN 4 THEN '  Trip to ' || c_mktsegment || '  ' ELSE '' END AS title,
      CASE WHEN o_orderkey % 3 <> 0 THEN 'Bring ' || second || chr(10) || 'Category: ' || lower(o_orderpriority) || ', other' || chr(13) || chr(10)
        || '  People : ' || fulln || ', , ' || second || chr(10) || 'people: Cy' || chr(10) || 'empty: ,' || chr(10) || ': none' END AS notes,
      CASE WHEN eight = 0 THEN 'https://example.com/j/' || o_orderkey WHEN eight = 1 THEN '+1 415-555-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')
        WHEN eight = 2 THEN 'Join on Zoom.us' WHEN eight = 3 THEN NULL ELSE 'Hall ' || (o_custkey % 20) END AS location,
      strftime(st, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 10 = 0 THEN '+02:00' ELSE 'Z' END AS start_text,
      strftime(st + to_minutes(30 * (1 + six)), '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 10 = 0 THEN '+02:00' ELSE 'Z' END AS end_text,
      o_orderkey % 11 = 0 AS is_all_day, c_mktsegment AS calendar, CASE WHEN o_orderkey % 5 <> 0 THEN '#00000' || (o_orderkey % 3) END AS calendar_color,
      CASE WHEN o_orderkey % 7 = 0 THEN ['Dee Day', second] ELSE [] END AS attendees, o_orderkey % 7 = 0 AS is_recurring FROM raw1)"""
TAGS = r"""ln AS (SELECT id, unnest(string_split_regex(notes, '\r\n|\n|\r')) AS line, generate_subscripts(string_split_regex(notes, '\r\n|\n|\r'), 1) AS pos FROM raw WHERE notes IS NOT NULL),
    kv AS (SELECT id, pos, lower(trim(regexp_extract(trim(line), '^([^:]{1,31}):\s*(.+)$', 1))) AS k,
      list_filter(list_transform(string_split(regexp_extract(trim(line), '^([^:]{1,31}):\s*(.+)$', 2), ','), lambda v: trim(v)), lambda v: v <> '') AS vs FROM ln),
    tg AS (SELECT id, k, flatten(list(vs ORDER BY pos)) AS vs FROM kv WHERE k <> '' AND len(vs) > 0 GROUP BY id, k)"""
NAMES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_extract({x}, '(?i)\bwith\s+(.+)$', 1),
      '[\s!?.…\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}]+$', ''), '\s*,?\s+and\s+', ', ', 'gi'), ','),
      lambda v: regexp_replace(regexp_replace(v, '^\s+|\s+$', '', 'g'), '[.,]+$', '')),
      lambda v: regexp_matches(v, '^[A-Z][\p{{L}}\p{{N}}_.''’-]*(\s+[A-Z][\p{{L}}\p{{N}}_.''’-]*)*$'))"""
JUNK = r"(?i)zoom\.us|meet\.google\.com|teams\.microsoft\.com|teams\.live\.com|webex\.com|^https?://|^[\d\s()+.\-]{7,}$"
NORMAL = rf"""{RAW}, {TAGS},
    p0 AS (SELECT raw.*, (SELECT vs FROM tg WHERE tg.id = raw.id AND k = 'category') AS cat, list_sort(list_distinct(list_concat(list_concat(attendees,
      coalesce((SELECT vs FROM tg WHERE tg.id = raw.id AND k = 'people'), [])), {NAMES.format(x='title')}))) AS ppl FROM raw),
    nm AS (SELECT owner_id, unnest(ppl) AS name FROM p0),
    nc AS (SELECT owner_id, string_split(name, ' ')[1] AS fn, name, count(*) AS c FROM nm WHERE contains(name, ' ') GROUP BY 1, 2, 3),
    best AS (SELECT owner_id, fn, name FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, fn ORDER BY c DESC, name) AS rk FROM nc) WHERE rk = 1),
    px AS (SELECT p0.id, list_sort(list_distinct(list(CASE WHEN len(ppl) > 1 THEN coalesce(b.name, m.name) ELSE m.name END))) AS people
      FROM (SELECT id, owner_id, ppl, unnest(ppl) AS name FROM p0) m JOIN p0 USING (id, ppl) LEFT JOIN best b ON b.owner_id = m.owner_id AND b.fn = m.name GROUP BY p0.id),
    nrm AS (SELECT p0.* EXCLUDE (location), coalesce(px.people, []) AS people, coalesce(cat[1], calendar) AS category,
      CASE WHEN regexp_matches(location, '{JUNK}') THEN NULL ELSE location END AS location,
      CAST(replace(replace(start_text, 'Z', ''), '+02:00', '') AS TIMESTAMP) - CASE WHEN start_text LIKE '%+02:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS "start",
      CAST(replace(replace(end_text, 'Z', ''), '+02:00', '') AS TIMESTAMP) - CASE WHEN end_text LIKE '%+02:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS "end"
      FROM p0 LEFT JOIN px USING (id))"""


def landed(spark) -> str:
    """A new folder for files that a query writes and reads back, in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/landed-{uuid.uuid4().hex}"


_RECORD = f"""title, notes, location, start_text, end_text, is_all_day, calendar, calendar_color, {joined('attendees')} AS attendees, is_recurring"""


def _record_columns(records_read):
    return records_read.select(
        "id", "title", "notes", "location", F.col("startDate").alias("start_text"), F.col("endDate").alias("end_text"),
        F.col("isAllDay").alias("is_all_day"), F.col("calendarTitle").alias("calendar"), F.col("calendarColorHex").alias("calendar_color"),
        "attendees", F.col("isRecurring").alias("is_recurring"),
    )


@query("json_events", f"WITH {RAW} SELECT id, {_RECORD} FROM raw")
def json_events(spark, folder):
    path = landed(spark)
    records.write_records(t.raw_orders(spark, folder).drop("owner_id"), path)
    return _record_columns(ev.read_events(spark, path))


@query("uploaded_events", f"WITH {RAW} SELECT 'up1:' || id AS id, {_RECORD} FROM raw")
def uploaded_events(spark, folder):
    path = landed(spark)
    records.write_records(t.raw_orders(spark, folder).drop("owner_id"), path)
    return _record_columns(ev.read_uploaded_events(spark, path, "up1"))


@query(
    "ics_events",
    f"""SELECT 'cal:o' || o_orderkey AS id, 'Order, ' || o_orderkey || '; open' AS title, 'Dock ' || o_custkey || ', Pier' AS location,
    'Category: Freight' || chr(10) || 'People: Ann, Clerk ' || (o_custkey % 9) AS notes,
    strftime(o_orderdate, '%Y-%m-%dT') || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00:00Z' AS start_text,
    strftime(o_orderdate, '%Y-%m-%dT') || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':30:00Z' AS end_text, false AS is_all_day, 'Orders' AS calendar,
    CAST(NULL AS VARCHAR) AS calendar_color, 'Clerk, ' || (o_custkey % 9) || '|c' || o_custkey || '@dock.example' AS attendees, o_orderkey % 7 = 0 AS is_recurring FROM orders""",
)
def ics_events(spark, folder):
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    clerk = (F.col("o_custkey") % 9).cast("string")
    hour = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"))
    event = F.concat_ws(
        "\r\n",
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:o"), key),
        F.concat(F.lit("SUMMARY:Order\\, "), key, F.lit("\\; op\r\n en")),
        F.concat(F.lit("LOCATION:Dock "), customer, F.lit("\\, Pier")),
        F.concat(F.lit("DESCRIPTION:Category: Freight\\nPeople: Ann\\, Clerk "), clerk),
        F.concat(F.lit("DTSTART:"), hour, F.lit("0000Z")),
        F.concat(F.lit("DTEND:"), hour, F.lit("3000Z")),
        F.concat(F.lit('ATTENDEE;CN="Clerk, '), clerk, F.lit('":mailto:clerk@dock.example')),
        F.concat(F.lit("ATTENDEE:mailto:c"), customer, F.lit("@dock.example")),
        F.when(F.col("o_orderkey") % 7 == 0, "RRULE:FREQ=WEEKLY"),
        F.lit("END:VEVENT"),
    )
    path = landed(spark)
    t.table(spark, folder, "orders").select(event).write.text(path)
    return _record_columns(ics.read_ics(spark, path, "cal", "Orders"))


ZONES = """BEGIN:VCALENDAR
X-WR-CALNAME:Port
BEGIN:VTIMEZONE
TZID:Harbour
BEGIN:DAYLIGHT
DTSTART:19700308T020000
RRULE:FREQ=YEARLY;BYMONTH=3;BYDAY=2SU
TZOFFSETFROM:+0300
TZOFFSETTO:+0400
END:DAYLIGHT
BEGIN:STANDARD
DTSTART:19701025T030000
RRULE:FREQ=YEARLY;BYMONTH=10;BYDAY=-1SU
TZOFFSETFROM:+0400
TZOFFSETTO:+0300
END:STANDARD
END:VTIMEZONE
BEGIN:VTIMEZONE
TZID:Pier
BEGIN:STANDARD
DTSTART:19950101T000000
TZOFFSETFROM:+0200
TZOFFSETTO:+0230
END:STANDARD
END:VTIMEZONE"""


@query(
    "ics_zoned_events",
    f"""WITH o AS (SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) AS w, o_orderkey % 7 AS kind, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders),
    d AS (SELECT *, make_date(y, 3, 8) AS m8, make_date(y, 4, 1) AS a1, make_date(y, 10, 31) AS o31 FROM o),
    s AS (SELECT *, m8 + CAST((7 - dayofweek(m8)) % 7 AS INTEGER) AS second_march, a1 + CAST((7 - dayofweek(a1)) % 7 AS INTEGER) AS first_april, o31 - CAST(dayofweek(o31) AS INTEGER) AS last_october FROM d),
    u AS (SELECT o_orderkey, kind, w, w - CASE
        WHEN kind = 0 THEN CASE WHEN w >= second_march + INTERVAL 3 HOUR AND w < last_october + INTERVAL 3 HOUR THEN INTERVAL 4 HOUR ELSE INTERVAL 3 HOUR END
        WHEN kind = 1 THEN CASE WHEN w >= first_april + INTERVAL 3 HOUR AND w < last_october + INTERVAL 2 HOUR THEN INTERVAL (-7) HOUR ELSE INTERVAL (-8) HOUR END
        WHEN kind = 2 THEN INTERVAL 9 HOUR
        WHEN kind = 3 THEN CASE WHEN w >= TIMESTAMP '1995-01-01 00:30:00' THEN INTERVAL 150 MINUTE ELSE INTERVAL 2 HOUR END
        ELSE INTERVAL 0 HOUR END AS utc FROM s)
    SELECT 'port:z' || o_orderkey AS id, 'Port' AS calendar, kind = 6 AS is_all_day,
      strftime(CASE WHEN kind = 6 THEN CAST(CAST(w AS DATE) AS TIMESTAMP) ELSE utc END, '%Y-%m-%dT%H:%M:%SZ') AS start_text FROM u""",
)
def ics_zoned_events(spark, folder):
    """Local times of a file's own zones, a Windows and an IANA zone, times without a zone or of an unknown one, and days."""
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 7
    day_text = F.date_format("o_orderdate", "yyyyMMdd")
    wall = F.concat(day_text, F.lit("T"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit("0000"))
    zone = F.element_at(F.array(*[F.lit(z) for z in (";TZID=Harbour:", ';TZID="Pacific Standard Time":', ";TZID=Asia/Tokyo:", ";TZID=Pier:", ":", ";TZID=Nowhere:", ";VALUE=DATE:")]), (kind + 1).cast("int"))
    value = F.when(kind == 6, day_text).otherwise(wall)
    event = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:z"), key), F.concat(F.lit("DTSTART"), zone, value), F.lit("END:VEVENT"))
    events = t.table(spark, folder, "orders").select((F.col("o_orderkey") % 5).alias("file"), F.lit(1).alias("line"), event.alias("value"))
    heads = spark.range(5).select(F.col("id").alias("file"), F.lit(0).alias("line"), F.lit(ZONES).alias("value"))
    path = landed(spark)
    # One file each, its zones first.
    dealt = events.union(heads).repartition("file").sortWithinPartitions("file", "line")
    dealt.drop("line").write.partitionBy("file").text(path)
    found = ics.read_ics(spark, path, "port", "Harbour")
    return found.select("id", F.col("calendarTitle").alias("calendar"), F.col("isAllDay").alias("is_all_day"), F.col("startDate").alias("start_text"))


@query(
    "normalize_events",
    rf"""WITH {NORMAL} SELECT owner_id, id, title, notes, location, {ts('"start"')} AS "start", {ts('"end"')} AS "end",
    {r("date_diff('microsecond', " + '"start", "end"' + ") / 3600000000.0")} AS duration_hours, is_all_day, calendar, category, calendar_color,
    {joined('people')} AS people, {n('len(people)')} AS n_people, is_recurring, CAST(NULL AS VARCHAR) AS url, {n('year("start")')} AS year,
    {n('month("start")')} AS month, {n('weekofyear("start")')} AS week, dayname("start") AS weekday,
    CASE WHEN month("start") IN (12, 1, 2) THEN 'winter' WHEN month("start") IN (3, 4, 5) THEN 'spring' WHEN month("start") IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season
    FROM nrm""",
)
def normalize_events(spark, folder):
    return ev.normalize_events(t.raw_orders(spark, folder), keys=["owner_id"])


@query(
    "full_names",
    rf"""WITH {NORMAL} SELECT owner_id, fn AS first_name, name AS full_name FROM best""",
)
def full_names(spark, folder):
    lists = ev.guest_lists(ev.normalize_columns(t.raw_orders(spark, folder)), ["owner_id"])
    return ev.full_name_by_first_name(lists, ["owner_id"])


@query(
    "note_tags",
    f"WITH {RAW}, {TAGS} SELECT id, k AS tag, {joined('vs')} AS tag_values FROM tg",
)
def note_tags(spark, folder):
    tags = text.parse_note_tags(F.col("notes"))
    return t.raw_orders(spark, folder).select("id", F.explode(tags).alias("tag", "tag_values"))


@query(
    "people_in_documents",
    rf"""WITH d AS (SELECT doc_id, {NAMES.format(x="text").replace("(?i)", "(?i)(?:^|[^" + chr(92) + "p{L}" + chr(92) + "p{M}" + chr(92) + "p{N}_])").replace(chr(92) + "bwith", "with")} AS names FROM documents)
    SELECT doc_id, array_to_string(names, '|') AS names FROM d WHERE len(names) > 0""",
)
def people_in_documents(spark, folder):
    names = text.people_from_title(F.col("text"))
    return t.table(spark, folder, "documents").select("doc_id", names.alias("names")).filter(F.size("names") > 0)


@query(
    "bare_titles",
    rf"""WITH {RAW}, s AS (SELECT title, {NAMES.format(x='title')} AS names FROM raw)
    SELECT CASE WHEN len(names) > 0 THEN regexp_replace(regexp_extract(title, '(?is)^(.*?)\bwith\s+[^\n]+$', 1), '\s+$', '') ELSE title END AS title, count(*) AS events
    FROM s GROUP BY 1""",
)
def bare_titles(spark, folder):
    raw = t.raw_orders(spark, folder)
    return raw.groupBy(text.strip_with_suffix(F.col("title")).alias("title")).agg(F.count("*").alias("events"))


@query(
    "junk_location",
    f"""WITH {RAW}, p AS (SELECT location AS place FROM raw UNION ALL SELECT url FROM pages UNION ALL SELECT c_name FROM customer)
    SELECT place, coalesce(regexp_matches(place, '{JUNK}'), false) AS junk, count(*) AS uses FROM p GROUP BY ALL""",
)
def junk_location(spark, folder):
    places = (
        t.raw_orders(spark, folder)
        .select(F.col("location").alias("place"))
        .unionAll(t.table(spark, folder, "pages").select("url"))
        .unionAll(t.table(spark, folder, "customer").select("c_name"))
    )
    junk = F.coalesce(text.is_junk_location(F.col("place")), F.lit(False))
    return places.groupBy("place", junk.alias("junk")).agg(F.count("*").alias("uses"))


_BOTH = f"""{RAW}, bb AS (SELECT id, title, start_text, end_text, 0 AS priority FROM raw
    UNION ALL SELECT 'copy:' || id, upper(title) || ' ', start_text, end_text, 1 FROM raw),
    dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(title)), start_text, end_text ORDER BY priority, id) AS k FROM bb) WHERE k = 1)"""


def _with_copies(spark, folder):
    raw = t.raw_orders(spark, folder).withColumn("priority", F.lit(0))
    copies = raw.withColumns(
        {
            "id": F.concat(F.lit("copy:"), "id"),
            "title": F.concat(F.upper("title"), F.lit(" ")),
            "priority": F.lit(1),
        }
    )
    return raw.unionByName(copies)


@query("dedupe_events", f"WITH {_BOTH} SELECT id, title, start_text AS \"startDate\", {n('priority')} AS priority FROM dd")
def dedupe_events(spark, folder):
    return dedupe.dedupe_events(_with_copies(spark, folder)).select("id", "title", "startDate", "priority")


@query(
    "dedupe_occurrences",
    f"""WITH {EVT} SELECT owner_id, id, {ts('"start"')} AS "start", title FROM (SELECT owner_id, title AS id, date_trunc('day', "start") AS "start", id AS title,
    row_number() OVER (PARTITION BY owner_id, title, date_trunc('day', "start") ORDER BY "end", id) AS k FROM evt) WHERE k = 1""",
)
def dedupe_occurrences(spark, folder):
    events = t.event_calendar(spark, folder).select(
        "owner_id", F.col("title").alias("id"), F.date_trunc("day", F.col("start")).cast("timestamp_ntz").alias("start"), "end",
        F.col("id").alias("title"),
    )
    return dedupe.dedupe_occurrences(events, ["owner_id"]).drop("end")


_SOURCES = """src AS (SELECT c_mktsegment AS source_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN false WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE true END AS visible
    FROM customer GROUP BY c_mktsegment)"""


def _sources(spark, folder):
    segment = F.col("c_mktsegment")
    visible = F.when(segment == "MACHINERY", False).when(segment == "BUILDING", F.lit(None)).otherwise(True)
    return t.table(spark, folder, "customer").groupBy(segment.alias("source_id")).agg(F.first(visible).alias("visible"))


@query(
    "merged_sources",
    f"WITH {RAW}, {_SOURCES} SELECT id, calendar AS source_id FROM raw JOIN src ON source_id = calendar WHERE coalesce(visible, true)",
)
def merged_sources(spark, folder):
    events = t.raw_orders(spark, folder).withColumn("source_id", F.col("calendarTitle"))
    return manifest.merged_source_events(_sources(spark, folder), events).select("id", "source_id")


@query(
    "combined_events",
    f"""WITH {RAW}, {_SOURCES}, bb AS (SELECT id, title, start_text, end_text, 0 AS priority FROM raw
      UNION ALL SELECT 'x:' || id, CASE WHEN calendar = 'FURNITURE' THEN 'Late ' || title ELSE upper(title) END, start_text, end_text, 1 FROM raw
      JOIN src ON source_id = calendar WHERE coalesce(visible, true)),
    dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(title)), start_text, end_text ORDER BY priority, id) AS k FROM bb) WHERE k = 1)
    SELECT id, title FROM dd""",
)
def combined_events(spark, folder):
    raw = t.raw_orders(spark, folder).drop("owner_id")
    late = F.concat(F.lit("Late "), "title")
    imported = raw.withColumns(
        {
            "source_id": F.col("calendarTitle"),
            "id": F.concat(F.lit("x:"), "id"),
            "title": F.when(F.col("calendarTitle") == "FURNITURE", late).otherwise(F.upper("title")),
        }
    )
    return manifest.combine(raw, imported, _sources(spark, folder)).select("id", "title")


@query(
    "sync_summary",
    f"""WITH {RAW}, {_SOURCES} SELECT source_id, visible, CASE WHEN source_id = 'HOUSEHOLD' THEN 7 ELSE count(raw.id) END AS event_count,
    CASE WHEN source_id <> 'HOUSEHOLD' THEN '2024-05-01 00:00:00.000000' END AS last_synced, CASE WHEN source_id = 'HOUSEHOLD' THEN 'timed out' END AS last_sync_error
    FROM src LEFT JOIN raw ON source_id = calendar GROUP BY source_id, visible""",
)
def sync_summary(spark, folder):
    sources = _sources(spark, folder).withColumns(
        {"event_count": F.lit(7).cast("bigint"), "last_synced": F.lit(None).cast("timestamp_ntz"), "last_sync_error": F.lit(None).cast("string")}
    )
    errors = sources.filter(F.col("source_id") == "HOUSEHOLD").select("source_id", F.lit("timed out").alias("error"))
    events = t.raw_orders(spark, folder).withColumn("source_id", F.col("calendarTitle"))
    return manifest.sync_summary(sources, events, timebins.naive(dt.datetime(2024, 5, 1)), errors)


_REQUESTS = """rq AS (SELECT c_custkey AS source_id, CASE c_custkey % 5 WHEN 0 THEN 'apple' WHEN 1 THEN 'google' WHEN 2 THEN 'outlook' WHEN 3 THEN 'other' ELSE 'fax' END AS provider,
    CASE c_custkey % 4 WHEN 0 THEN 'ics_url' WHEN 1 THEN 'ics_file' WHEN 2 THEN 'events_json' ELSE 'caldav' END AS kind,
    CASE WHEN c_custkey % 3 = 0 THEN 'https://example.com/' || c_custkey ELSE '' END AS url, c_custkey % 7 <> 0 AS has_file FROM customer)"""


@query(
    "check_sources",
    f"""WITH {_REQUESTS} SELECT *, CASE WHEN provider = 'fax' THEN 'unknown provider' WHEN kind = 'caldav' THEN 'unknown kind'
    WHEN kind = 'ics_url' AND url = '' THEN 'url is required' WHEN kind IN ('ics_file', 'events_json') AND NOT has_file THEN 'file is required' END AS error FROM rq""",
)
def check_sources(spark, folder):
    key = F.col("c_custkey")

    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))

    requests = t.table(spark, folder, "customer").select(
        key.alias("source_id"),
        pick(["apple", "google", "outlook", "other", "fax"]).alias("provider"),
        pick(["ics_url", "ics_file", "events_json", "caldav"]).alias("kind"),
        F.when(key % 3 == 0, F.concat(F.lit("https://example.com/"), key.cast("string"))).otherwise("").alias("url"),
        (key % 7 != 0).alias("has_file"),
    )
    return manifest.check_sources(requests)


_OVER = """ov AS (SELECT 'Nation ' || n_nationkey || ' / ' || CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 99 END AS location,
    CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * 1.5 END AS lat, n_nationkey * -2.5 AS lon, 'Fixed ' || n_name AS display_name FROM nation)"""


def _overrides(spark, folder):
    key = F.col("n_nationkey")
    return t.table(spark, folder, "nation").select(
        F.concat(F.lit("Nation "), key.cast("string"), F.lit(" / "), F.when(key % 2 == 0, "0").otherwise("99")).alias("location"),
        F.when(key % 5 != 0, key * F.lit(1.5)).alias("lat"),
        (key * F.lit(-2.5)).alias("lon"),
        F.concat(F.lit("Fixed "), "n_name").alias("display_name"),
    )


@query(
    "effective_geo",
    f"""WITH {GEO}, {_OVER}, v AS (SELECT * FROM ov WHERE lat IS NOT NULL AND lon IS NOT NULL)
    SELECT coalesce(v.location, g.location) AS location, {r('CASE WHEN v.location IS NULL THEN g.lat ELSE v.lat END')} AS lat,
    {r('CASE WHEN v.location IS NULL THEN g.lon ELSE v.lon END')} AS lon, CASE WHEN v.location IS NULL THEN g.display_name ELSE v.display_name END AS display_name,
    CASE WHEN v.location IS NULL THEN g.city END AS city FROM geo g FULL JOIN v ON v.location = g.location""",
)
def effective_geo(spark, folder):
    merged = geo_src.effective_geo(t.order_geo(spark, folder), _overrides(spark, folder))
    return merged.select("location", "lat", "lon", "display_name", "city")


@query(
    "upsert_overrides",
    f"""WITH {_OVER}, ch AS (SELECT 'Nation ' || c_nationkey || ' / 0' AS location, c_acctbal AS lat, CASE WHEN c_custkey % 4 <> 0 THEN 1.0 * c_custkey END AS lon, c_custkey AS changed_at FROM customer),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY changed_at DESC) AS k FROM ch WHERE lon IS NOT NULL) WHERE k = 1)
    SELECT location, {r('lat')} AS lat, {r('lon')} AS lon FROM l UNION ALL SELECT location, {r('lat')}, {r('lon')} FROM ov WHERE location NOT IN (SELECT location FROM l)""",
)
def upsert_overrides(spark, folder):
    changes = t.table(spark, folder, "customer").select(
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"), F.lit(" / 0")).alias("location"),
        F.col("c_acctbal").alias("lat"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey").cast("double")).alias("lon"),
        F.col("c_custkey").alias("changed_at"),
    )
    return geo_src.upsert_overrides(_overrides(spark, folder), changes).select("location", "lat", "lon")


@query("clear_entries", f"WITH {GEO}, {_OVER} SELECT location, {r('lat')} AS lat FROM geo WHERE location NOT IN (SELECT location FROM ov)")
def clear_entries(spark, folder):
    return geo_src.clear_entries(t.order_geo(spark, folder), _overrides(spark, folder)).select("location", "lat")


@query("count_cleared", f"WITH {GEO}, {_OVER} SELECT count(*) AS removed FROM geo WHERE location IN (SELECT location FROM ov)")
def count_cleared(spark, folder):
    return geo_src.count_cleared(t.order_geo(spark, folder), _overrides(spark, folder))


@query("geocoded_count", f"WITH {_OVER} SELECT count(lat) AS n_geocoded FROM ov")
def geocoded_count(spark, folder):
    return geo_src.geocoded_count(_overrides(spark, folder))


@query(
    "global_filters",
    f"""WITH {CAL} SELECT id, {ts('"start"')} AS "start", category FROM cal WHERE "start" >= TIMESTAMP '1996-03-01' AND "start" < TIMESTAMP '1999-07-02'
    AND lower(category) NOT IN ('5-low', '2-high')""",
)
def global_filters(spark, folder):
    events = t.order_calendar(spark, folder)
    kept = filters.global_filters(events, dt.date(1996, 3, 1), dt.date(1999, 7, 1), ["5-Low", "", "2-HIGH"])
    return kept.select("id", "start", "category")


@query(
    "export_filter",
    f"""WITH {CAL} SELECT calendar, {n('year')} AS year, count(*) AS events FROM cal WHERE calendar IN ('BUILDING', 'MACHINERY')
    AND "start" >= TIMESTAMP '1997-01-01' AND "start" < TIMESTAMP '1999-01-01' GROUP BY calendar, year""",
)
def export_filter(spark, folder):
    first, last = dt.datetime(1997, 1, 1), dt.datetime(1999, 1, 1)
    kept = ev.export_filter(t.order_calendar(spark, folder), ["BUILDING", "MACHINERY"], first, last)
    return kept.groupBy("calendar", "year").agg(F.count("*").alias("events"))


@query(
    "date_partners",
    f"WITH {EVT} SELECT id, people[1] AS date_partner FROM evt WHERE category IN ('purchase', 'signup')",
)
def date_partners(spark, folder):
    events = t.event_calendar(spark, folder)
    return filters.date_events(events, ["Purchase", "SIGNUP"]).select("id", "date_partner")


@query(
    "located_events",
    f"WITH {EVT} SELECT location, list_contains(people, 'P3') AS with_p3, count(*) AS events FROM evt WHERE location IS NOT NULL GROUP BY ALL",
)
def located_events(spark, folder):
    located = filters.located_events(t.event_calendar(spark, folder))
    return located.groupBy("location", F.array_contains("people", "P3").alias("with_p3")).agg(F.count("*").alias("events"))


@query(
    "travel_titles",
    f"WITH {RAW} SELECT id, title FROM raw WHERE lower(calendar) = 'household' OR regexp_matches(title, '(?i)\\b(?:flight|trip to|traveling to|travelling to|vacation|vacay)\\b')",
)
def travel_titles(spark, folder):
    raw = t.raw_orders(spark, folder).withColumn("category", F.col("calendarTitle"))
    return filters.travel_events(raw, ["Household"]).select("id", "title")


@query(
    "cadence_labels",
    """SELECT CASE WHEN d <= 2 THEN 'daily' WHEN d <= 9 THEN 'weekly' WHEN d <= 18 THEN 'biweekly' WHEN d <= 45 THEN 'monthly' WHEN d <= 100 THEN 'quarterly' ELSE 'yearly' END AS cadence,
    count(*) AS rows FROM (SELECT l_quantity * (1 + l_linenumber) / 2 AS d FROM lineitem) GROUP BY 1""",
)
def cadence_labels(spark, folder):
    days = F.col("l_quantity") * (1 + F.col("l_linenumber")) / 2
    lines = t.table(spark, folder, "lineitem")
    return lines.groupBy(timebins.cadence_label(days).alias("cadence")).agg(F.count("*").alias("rows"))


@query(
    "week_strip",
    f"""WITH {CAL} SELECT {n('(dayofyear("start") - 1) // 7')} AS week_column, strftime("start", '%Y-%m') AS month_label, {day('week')} AS week_ending, count(*) AS events FROM cal GROUP BY ALL""",
)
def week_strip(spark, folder):
    events = t.order_calendar(spark, folder)
    start = F.col("start")
    return events.groupBy(
        timebins.week_strip_column(start).alias("week_column"),
        timebins.period_label(timebins.month_start(start), "month").alias("month_label"),
        timebins.week_ending(start).alias("week_ending"),
    ).agg(F.count("*").alias("events"))


_OSM_CLASSES = ["place", "building", "amenity", "shop", "leisure", "highway", ""]
_OSM_TYPES = ["house", "apartments", "retail", "school", "restaurant", "theatre", "civic", "church", "bar", "park", "clinic"]


@query(
    "place_type",
    f"""WITH o AS (SELECT {_OSM_CLASSES}[CAST(p_partkey % 7 + 1 AS INTEGER)] AS osm_class, {_OSM_TYPES}[CAST(p_partkey % 11 + 1 AS INTEGER)] AS osm_type FROM part)
    SELECT osm_class, osm_type, CASE
      WHEN osm_class = 'place' AND osm_type = 'house' THEN 'residential'
      WHEN osm_class = 'building' AND osm_type IN ('house', 'apartments') THEN 'residential'
      WHEN osm_class = 'building' AND osm_type = 'retail' THEN 'commercial'
      WHEN osm_class = 'building' AND osm_type IN ('school', 'civic', 'church') THEN 'public'
      WHEN osm_class = 'amenity' AND osm_type IN ('restaurant', 'bar') THEN 'commercial'
      WHEN osm_class = 'amenity' AND osm_type = 'theatre' THEN 'recreational'
      WHEN osm_class = 'amenity' THEN 'public' WHEN osm_class = 'shop' THEN 'commercial' WHEN osm_class = 'leisure' THEN 'recreational' ELSE 'unknown' END AS place_type,
    count(*) AS places FROM o GROUP BY ALL""",
)
def place_type(spark, folder):
    key = F.col("p_partkey")

    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))

    parts = t.table(spark, folder, "part").select(pick(_OSM_CLASSES).alias("osm_class"), pick(_OSM_TYPES).alias("osm_type"))
    kind = geo_fn.classify_place(F.col("osm_class"), F.col("osm_type"))
    return parts.groupBy("osm_class", "osm_type", kind.alias("place_type")).agg(F.count("*").alias("places"))


_ADDRESS_FIELDS = ["city", "town", "village", "municipality", "county", "suburb", "neighbourhood", "quarter", "city_district", "borough"]


@query(
    "structured_addresses",
    f"""WITH f AS (SELECT c_custkey AS k, {', '.join(f"CASE WHEN (c_custkey // {i + 1}) % 3 = 0 THEN '{name} ' || c_nationkey WHEN (c_custkey // {i + 1}) % 3 = 1 THEN '' END AS {name}" for i, name in enumerate(_ADDRESS_FIELDS))} FROM customer)
    SELECT k AS customer, coalesce(nullif(city, ''), nullif(town, ''), nullif(village, ''), nullif(municipality, ''), nullif(county, '')) AS city,
      coalesce(nullif(suburb, ''), nullif(neighbourhood, ''), nullif(quarter, ''), nullif(city_district, ''), nullif(borough, '')) AS neighbourhood FROM f""",
)
def structured_addresses(spark, folder):
    """City and neighbourhood of structured addresses of which any field may be missing or empty."""

    def filled(i, name):
        third = F.floor(F.col("c_custkey") / (i + 1)) % 3
        return F.when(third == 0, F.concat(F.lit(f"{name} "), F.col("c_nationkey").cast("string"))).when(third == 1, "").alias(name)

    address = F.struct(*[filled(i, name) for i, name in enumerate(_ADDRESS_FIELDS)])
    customers = t.table(spark, folder, "customer").select(F.col("c_custkey").alias("customer"), address.alias("address"))
    return customers.select("customer", geo_fn.address_city(F.col("address")).alias("city"), geo_fn.address_neighbourhood(F.col("address")).alias("neighbourhood"))


@query(
    "geo_entries",
    f"""WITH {GEO} SELECT location, CASE WHEN lat >= 0 THEN {r('lat')} END AS lat, CASE WHEN lat >= 0 THEN {r('lon')} END AS lon,
      CASE WHEN lat >= 0 THEN city END AS city, CASE WHEN lat >= 0 THEN country END AS country FROM geo""",
)
def geo_entries(spark, folder):
    """Place files as JSON objects, one for each nation, in which places without coordinates are null."""
    places = t.order_geo(spark, folder)
    entry = F.when(F.col("lat") >= 0, F.to_json(F.struct("lat", "lon", "city", "country"))).otherwise(F.lit("null"))
    # A name in quotes as JSON writes it.
    name = F.regexp_extract(F.to_json(F.struct(F.col("location").alias("k"))), r'^\{"k":(.*)\}$', 1)
    files = places.groupBy("lat").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(name, F.lit(": "), entry)), ",\n"), F.lit("}")).alias("value"))
    path = landed(spark)
    files.repartition("lat").select(F.floor("lat").alias("nation"), "value").write.partitionBy("nation").text(path)
    return geo_src.read_geo_json(spark, f"{path}/*/*.txt").select("location", "lat", "lon", "city", "country")


@query(
    "region_labels",
    f"""WITH {GEO}, g AS (SELECT *, lat < -20 AS bare, lat < 20 AS cityless FROM geo)
    SELECT location, CASE WHEN bare THEN 'Port ' || chr(65 + nation) || ', Land ' || chr(65 + nation) WHEN cityless THEN country ELSE city || ', ' || country END AS region FROM g""",
)
def region_labels(spark, folder):
    places = t.order_geo(spark, folder)
    country = F.when(F.col("lat") >= -20, F.col("country"))
    city = F.when(F.col("lat") >= 20, F.col("city"))
    letter = F.chr(F.lit(65) + (F.col("lat") + 60) / 5)
    line = F.concat("display_name", F.lit(", 12 Main, Port "), letter, F.lit(", 90210, Land "), letter)
    label = geo_fn.region_label(city, country, F.when(F.col("lat") < -20, line).otherwise(F.col("display_name")))
    return places.select("location", label.alias("region"))
