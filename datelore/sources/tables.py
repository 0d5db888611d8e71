"""Calendar-shaped views over the sample tables (orders, customers, events, ...).

They let every report run on data of any size without a calendar export: an order
becomes an event of its customer's nation, an event row becomes a short meeting of
its user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.functions import timebins


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _calendar_parts(start: Column) -> dict[str, Column]:
    return {
        "duration_hours": timebins.hours_between(F.col("start"), F.col("end")),
        "year": F.year(start),
        "month": F.month(start),
        "week": F.weekofyear(start),
        "weekday": timebins.weekday_name(start),
        "season": timebins.season(F.month(start)),
    }


def _order_people(spark: SparkSession, folder: str) -> DataFrame:
    """Guests of an order: one per supplier group of its lines."""
    lines = table(spark, folder, "lineitem")
    guest = F.concat(F.lit("S"), (F.col("l_suppkey") % 40).cast("string"))
    return lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set(guest)).alias("people"))


def order_calendar(spark: SparkSession, folder: str, people: bool = False) -> DataFrame:
    """Orders as events of the nation (``owner_id``) of their customer."""
    orders = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    nobody = F.array().cast("array<string>")
    if people:
        orders = orders.join(_order_people(spark, folder), "o_orderkey", "left")
    place = F.concat(
        F.lit("Nation "), F.col("c_nationkey").cast("string"), F.lit(" / "), (customer % 8).cast("string")
    )
    guests = F.when(key % 4 == 0, " with Sam Lee and Priya").otherwise("")
    start = F.col("o_orderdate") + F.make_dt_interval(hours=(key % 24).cast("int"))
    rows = orders.select(
        F.col("c_nationkey").cast("bigint").alias("owner_id"),
        key.cast("string").alias("id"),
        F.concat(F.lit("Visit "), (customer % 50).cast("string"), guests).alias("title"),
        F.lit(None).cast("string").alias("notes"),
        F.when(key % 9 != 0, place).alias("location"),
        start.alias("start"),
        (start + F.make_dt_interval(mins=(30 * (1 + key % 6)).cast("int"))).alias("end"),
        (key % 11 == 0).alias("is_all_day"),
        F.col("c_mktsegment").alias("calendar"),
        F.col("o_orderpriority").alias("category"),
        F.when(key % 5 != 0, F.concat(F.lit("#00000"), (key % 3).cast("string"))).alias("calendar_color"),
        (F.coalesce("people", nobody) if people else nobody).alias("people"),
        (key % 7 == 0).alias("is_recurring"),
        F.lit(None).cast("string").alias("url"),
    )
    return rows.withColumns({**_calendar_parts(F.col("start")), "n_people": F.size("people")})


def order_geo(spark: SparkSession, folder: str) -> DataFrame:
    """Places of :func:`order_calendar`; the places of one nation lie within one metro radius."""
    spots = table(spark, folder, "customer").select("c_nationkey", (F.col("c_custkey") % 8).alias("spot")).distinct()
    nations = table(spark, folder, "nation")
    nation, spot = F.col("c_nationkey"), F.col("spot")
    number = nation.cast("string")
    return spots.join(nations, nation == F.col("n_nationkey")).select(
        F.concat(F.lit("Nation "), number, F.lit(" / "), spot.cast("string")).alias("location"),
        (F.lit(-60.0) + 5.0 * nation).alias("lat"),
        (F.lit(-150.0) + 12.0 * nation + F.lit(0.1) * spot).alias("lon"),
        F.concat(F.lit("Spot "), spot.cast("string"), F.lit(", "), F.col("n_name")).alias("display_name"),
        F.concat(F.when(spot < 5, "City ").otherwise("Town "), number).alias("city"),
        F.concat(F.lit("Country "), F.col("n_regionkey").cast("string")).alias("country"),
        F.when(spot % 3 != 0, F.concat(F.lit("Quarter "), (spot % 3).cast("string"))).alias("neighbourhood"),
        F.lit(None).cast("string").alias("state"),
        F.when(spot % 2 == 0, "commercial").alias("place_type"),
    )


def customer_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as events at their customer's own place, of which there are as many as customers with orders."""
    return order_calendar(spark, folder).drop("location").join(
        table(spark, folder, "orders").select(
            F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("location")
        ),
        "id",
    )


def customer_geo(spark: SparkSession, folder: str) -> DataFrame:
    """Places of :func:`customer_calendar`, strewn over one country so that metro areas overlap and chain."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("C"), key.cast("string")).alias("location"),
        (F.lit(40.0) + (key * 37 % 1009) / F.lit(250.0)).alias("lat"),
        (F.lit(2.0) + (key * 101 % 1013) / F.lit(180.0)).alias("lon"),
        *[F.lit(None).cast("string").alias(c) for c in ("display_name", "city", "country", "neighbourhood", "state", "place_type")],
    )


def event_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the events table as meetings of their user (``owner_id``)."""
    return event_calendar_rows(table(spark, folder, "events"))


def event_calendar_rows(source: DataFrame) -> DataFrame:
    """The same for any batch or stream of such rows."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = source.withColumn("_k", k).select(
        F.col("user_id").alias("owner_id"),
        F.col("event_id").cast("string").alias("id"),
        F.concat("event_type", F.lit(" "), (F.col("_k") % 7).cast("string")).alias("title"),
        F.lit(None).cast("string").alias("notes"),
        F.when(F.col("_k") % 5 != 0, F.concat(F.lit("Place "), (F.col("_k") % 25).cast("string"))).alias("location"),
        F.col("ts").alias("start"),
        (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("end"),
        (F.col("_k") % 10 == 0).alias("is_all_day"),
        F.col("event_type").alias("calendar"),
        F.col("event_type").alias("category"),
        F.lit(None).cast("string").alias("calendar_color"),
        F.sort_array(
            F.array_distinct(
                F.array(
                    F.concat(F.lit("P"), (F.col("user_id") % 10).cast("string")),
                    F.concat(F.lit("P"), (F.col("_k") % 10).cast("string")),
                )
            )
        ).alias("people"),
        F.lit(False).alias("is_recurring"),
        F.lit(None).cast("string").alias("url"),
    )
    return rows.withColumns({**_calendar_parts(F.col("start")), "n_people": F.size("people")})


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as raw export records, with the irregular text real exports have."""
    orders = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    first = F.concat(F.lit("Ana"), F.chr(F.lit(97) + customer % 13))
    full = F.concat(first, F.lit(" L"), F.chr(F.lit(97) + (customer + key % 3) % 7), F.lit("e"))
    second = F.concat(F.lit("Bo"), F.chr(F.lit(97) + key % 5))
    title = (
        F.when(key % 6 == 0, F.concat(F.lit("Dinner with "), full))
        .when(key % 6 == 1, F.concat(F.lit("Game night with "), first, F.lit(", "), second, F.lit(", and the twins")))
        .when(key % 6 == 2, F.concat(F.lit("Lunch With "), first, F.lit(" and "), full, F.lit(" 🎉!")))
        .when(key % 6 == 3, F.lit("Standup with the whole team"))
        .when(key % 6 == 4, F.concat(F.lit("  Trip to "), F.col("c_mktsegment"), F.lit("  ")))
        .otherwise(F.lit(""))
    )
    notes = F.when(
        key % 3 != 0,
        F.concat(
            F.lit("Bring "), second, F.lit("\nCategory: "), F.lower("o_orderpriority"),
            F.lit(", other\r\n  People : "), full, F.lit(", , "), second, F.lit("\npeople: Cy\nempty: ,\n: none"),
        ),
    )
    tags = F.when(
        key % 3 != 0,
        F.create_map(
            F.lit("category"), F.array(F.lower("o_orderpriority"), F.lit("other")),
            F.lit("people"), F.array(full, second, F.lit("Cy")),
        ),
    )
    location = (
        F.when(key % 8 == 0, F.concat(F.lit("https://example.com/j/"), key.cast("string")))
        .when(key % 8 == 1, F.concat(F.lit("+1 415-555-"), F.lpad((key % 10000).cast("string"), 4, "0")))
        .when(key % 8 == 2, F.lit("Join on Zoom.us"))
        .when(key % 8 == 3, F.lit(None))
        .otherwise(F.concat(F.lit("Hall "), (customer % 20).cast("string")))
    )
    start = F.col("o_orderdate") + F.make_dt_interval(hours=(key % 24).cast("int"))
    end = start + F.make_dt_interval(mins=(30 * (1 + key % 6)).cast("int"))
    stamp = lambda ts: F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))
    zone = F.when(key % 10 == 0, "+02:00").otherwise("Z")
    return orders.select(
        F.col("c_nationkey").cast("bigint").alias("owner_id"),
        key.cast("string").alias("id"),
        title.alias("title"),
        notes.alias("notes"),
        location.alias("location"),
        F.concat(stamp(start), zone).alias("startDate"),
        F.concat(stamp(end), zone).alias("endDate"),
        (key % 11 == 0).alias("isAllDay"),
        F.col("c_mktsegment").alias("calendarTitle"),
        F.when(key % 5 != 0, F.concat(F.lit("#00000"), (key % 3).cast("string"))).alias("calendarColorHex"),
        F.when(key % 7 == 0, F.array(F.lit("Dee Day"), second)).otherwise(F.array().cast("array<string>")).alias("attendees"),
        (key % 7 == 0).alias("isRecurring"),
        F.lit(None).cast("string").alias("url"),
        tags.alias("noteTags"),
    )


def customer_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """One address line per order, in the untidy shapes map pickers produce: (owner_id, location, category)."""
    orders = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    key, customer = F.col("o_orderkey"), F.col("o_custkey")

    def pick(number: Column, values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))

    name = pick(key, ["", "", "7 Hills Bakery ", "Juniper Park ", "Cottage ", "9th Street Books "])
    number = (customer % 900 + 1).cast("string")
    street = pick(customer, [" Marigold Blvd", " 8th St SE", " Orchard Blvd N", " Las Flores", " Quarry Lane", " Tanner Row"])
    unit = pick(F.floor(key / 3), ["", "", ", Unit 733", " Apt. 52", " #K17", ", Unit C&F"])
    gap = pick(F.floor(key / 5), [", ", " ", ",  "])
    city = pick(customer, ["Los Angeles", "Boulder", "Van Nuys", "Fresno", "Grass Valley"])
    state = pick(customer, [", CA", ", CO", ", CA", " CA", " CA"])
    code = F.when(key % 4 != 0, F.concat(F.lit(" 9"), F.lpad((customer % 9999).cast("string"), 4, "0"))).otherwise("")
    country = pick(F.floor(key / 7), [", United States", " United States", ", USA", ""])
    full = F.concat(name, number, street, unit, gap, city, state, code, country)
    bare = F.concat(pick(customer, ["Lecture Room ", "East Lawn ", "UCLA Annex ", "Amgen Lobby "]), (customer % 300).cast("string"))
    return orders.select(
        F.col("c_nationkey").cast("bigint").alias("owner_id"),
        F.when(key % 9 == 0, bare).otherwise(full).alias("location"),
        pick(key, ["Work", "UCLA lectures", "Social"]).alias("category"),
    )


def gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    """A place table for the addresses above: one tidy street address per customer."""
    customers = table(spark, folder, "customer")
    key = F.col("c_custkey")

    def pick(values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))

    street = pick([" Marigold Blvd", " 8th St", " Orchard Blvd", " Las Flores", " Quarry Lane", " Tanner Row"])
    city = pick(["Los Angeles", "Boulder", "Los Angeles", "Fresno", "Grass Valley"])
    state = pick(["CA", "CO", "CA", "CA", "CA"])
    code = F.concat(F.lit(" 9"), F.lpad((key % 9999).cast("string"), 4, "0"))
    query = F.concat(
        (key % 900 + 1).cast("string"), street, F.lit(", "), city, F.lit(", "), state, code, F.lit(", United States")
    )
    return customers.select(
        query.alias("query"),
        key.alias("rank"),
        (F.lit(30.0) + (key % 100) / 10.0).alias("lat"),
        (F.lit(-120.0) + (key % 70) / 10.0).alias("lon"),
        query.alias("display_name"),
        city.alias("city"),
        F.lit("United States").alias("country"),
        F.lit(None).cast("string").alias("neighbourhood"),
        state.alias("state"),
        F.lit("residential").alias("place_type"),
    )
