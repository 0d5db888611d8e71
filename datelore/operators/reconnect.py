"""Whom to invite to upcoming events, from the calendar's own history."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelore.operators.common import top_value
from datelore.operators.filters import history, upcoming_events
from datelore.operators.people import days_since_seen, exploded_people, last_event_with, shared_categories
from datelore.operators.regions import guess_regions, metro_map
from datelore.operators.sequences import ranked

# --- Fixed values ---
MAX_DAYS_SINCE_SEEN = 730
DAYS_AHEAD = 14
PICKS_PER_EVENT = 5
# --- end of fixed values ---


def location_regions(locations: DataFrame, metros: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Region of each place: its own metro, else the one its text names."""
    on = [*keys, "location"]
    places = locations.select(*on).distinct()
    known = places.join(metros, on, "left")
    guessed = guess_regions(known.filter(F.col("metro").isNull()), metros, keys)
    joined = known.join(guessed.withColumnRenamed("metro", "_guess"), on, "left")
    return joined.select(*on, F.coalesce("metro", "_guess").alias("region")).filter(F.col("region").isNotNull())


def usual_region(df: DataFrame, regions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The region each person is met in most; ties go to the smaller label."""
    keys = list(keys)
    located = df.filter(F.col("location").isNotNull())
    per_place = exploded_people(located).groupBy(*keys, "person", "location").agg(F.count("*").alias("_n"))
    placed = per_place.join(regions, [*keys, "location"])
    counted = placed.groupBy(*keys, "person", "region").agg(F.sum("_n").alias("_n"))
    return top_value(counted, [*keys, "person"], "region", "_n")


def _sides(
    df: DataFrame, as_of: Column, metros: DataFrame | None, days_ahead: int, max_days_since_seen: float, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Upcoming events with their region, and who may be invited in each category, with the region they are usually met in."""
    keys = list(keys)
    past = history(df, as_of)
    upcoming = upcoming_events(df, as_of, days_ahead).select(
        *keys,
        F.col("id").alias("event_id"),
        F.col("title").alias("event_title"),
        F.col("category").alias("event_category"),
        F.col("start").alias("event_start"),
        F.col("location").alias("event_location"),
        F.col("people").alias("_guests"),
    )
    met_in = shared_categories(past, keys).withColumnRenamed("category", "event_category")
    recent = days_since_seen(past, as_of, keys).filter(F.col("days_since_seen") <= max_days_since_seen)
    eligible = met_in.join(recent.select(*keys, "person", "days_since_seen"), [*keys, "person"])
    if metros is None:
        upcoming = upcoming.withColumn("region", F.lit(None).cast("string"))
        eligible = eligible.withColumn("_usual", F.lit(None).cast("string"))
    else:
        places = df.filter(F.col("location").isNotNull()).select(*keys, "location")
        regions = location_regions(places, metros, keys)
        by_place = regions.withColumnRenamed("location", "event_location")
        upcoming = upcoming.join(by_place, [*keys, "event_location"], "left")
        usual = usual_region(past, regions, keys).withColumnRenamed("region", "_usual")
        eligible = eligible.join(usual, [*keys, "person"], "left")
    return upcoming, eligible


def _pairs(upcoming: DataFrame, eligible: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each upcoming event with everyone who may be invited to it."""
    fits = F.col("region").isNull() | F.coalesce(F.col("region") == F.col("_usual"), F.lit(False))
    return upcoming.join(eligible, [*keys, "event_category"]).filter(~F.array_contains("_guests", F.col("person")) & fits)


def invite_candidates(
    df: DataFrame,
    as_of: Column,
    metros: DataFrame | None = None,
    days_ahead: int = DAYS_AHEAD,
    max_days_since_seen: float = MAX_DAYS_SINCE_SEEN,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Everyone eligible for each upcoming event, which is a row for each of them.

    Eligible: seen within the limit, met before in the event's category, not on the
    guest list and, when the event's region is known, usually met in that region.
    ``metros`` (location, metro) comes from the history; without it only the other
    rules apply.
    """
    keys = list(keys)
    upcoming, eligible = _sides(df, as_of, metros, days_ahead, max_days_since_seen, keys)
    return _pairs(upcoming, eligible, keys).select(
        *keys,
        "event_id",
        "event_title",
        "event_category",
        "event_start",
        "event_location",
        "region",
        "person",
        "days_since_seen",
    )


def ring_candidates(upcoming: DataFrame, eligible: DataFrame, top_n: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """As many eligible people for each event as serving it can need: with ``turn`` of the event and ``rank`` of the person.

    The people of a category, and those of them usually met in one region, stand on a ring in the order of a
    draw (the md5 of seed and person). An event starts at a place drawn for it and takes people from there on. The
    j-th event of a calendar can only need its first ``top_n * j`` people who are not its guests,
    because the events before it have taken ``top_n * (j - 1)`` at most; so rows follow events and not people.
    """
    keys = list(keys)
    at_ring = [*keys, "event_category", "_ring"]
    everyone = F.lit("all")
    own = F.concat(F.lit("="), F.col("_usual"))
    standing = eligible.withColumn("_ring", F.explode(F.when(F.col("_usual").isNull(), F.array(everyone)).otherwise(F.array(everyone, own))))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("person")))
    drawn = standing.select(*at_ring, "person", "days_since_seen", draw.alias("_draw"))
    members = ranked(drawn, at_ring, ["_draw", "person"], "_place").drop("_draw")
    sizes = drawn.groupBy(*at_ring).agg(F.count("*").alias("_size"))

    events = ranked(upcoming, keys, ["event_start", "event_id"], "turn")
    placed = events.withColumn("_ring", F.coalesce(F.concat(F.lit("="), F.col("region")), everyone)).join(sizes, at_ring)
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("event_id"))), 1, 13), 16, 10).cast("long")
    need = F.least("_size", F.col("turn") * top_n + F.size("_guests"))
    asked = placed.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), need - 1)))
    asked = asked.withColumn("_place", (start + F.col("rank")) % F.col("_size") + 1)
    met = asked.join(members, [*at_ring, "_place"]).filter(~F.array_contains("_guests", F.col("person")))
    return met.select(
        *keys, "event_id", "event_title", "event_category", "event_start", "event_location", "region", "person", "days_since_seen", "turn", "rank"
    )


def drawn_candidates(upcoming: DataFrame, eligible: DataFrame, top_n: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Everyone eligible for each event in the order of its own draw, with ``turn`` of the event and ``rank`` of the person.

    The draw is the md5 of seed, event and person, so all pairs of an event and a person take part. The j-th event of
    a calendar can only need its first ``top_n * j`` people, because the events before it have taken
    ``top_n * (j - 1)`` at most; the others are left out once they are ranked.
    """
    keys = list(keys)
    events = ranked(upcoming, keys, ["event_start", "event_id"], "turn")
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("event_id"), F.col("person")))
    of_event = Window.partitionBy(*keys, "turn").orderBy("_draw", "person")
    met = _pairs(events, eligible, keys).withColumn("_draw", draw).withColumn("rank", F.row_number().over(of_event))
    return met.filter(F.col("rank") <= F.col("turn") * top_n).select(
        *keys, "event_id", "event_title", "event_category", "event_start", "event_location", "region", "person", "days_since_seen", "turn", "rank"
    )


def served_in_order(candidates: DataFrame, top_n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The rows of up to ``top_n`` people for each event; those not picked for an earlier event of the calendar come first.

    Candidates pass once, sorted by calendar, turn and rank. What is held is the people picked in the calendar and
    ``top_n`` rows of either kind for one event, however many events and candidates there are.
    """
    keys = list(keys)
    dealt = candidates.repartition(*keys) if keys else candidates.repartition(1)
    passing = dealt.sortWithinPartitions(*keys, "turn", "rank")

    def serve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calendar, turn, known, fresh, again = None, None, set(), [], []

        def picks() -> list[dict]:
            chosen = (fresh + again)[:top_n]
            known.update(row["person"] for row in chosen)
            return chosen

        schema = None
        for batch in batches:
            schema, out = batch.schema, []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if (own, row["turn"]) != (calendar, turn):
                    out += picks()
                    fresh, again = [], []
                    if own != calendar:
                        known = set()
                    calendar, turn = own, row["turn"]
                side = again if row["person"] in known else fresh
                if len(side) < top_n:
                    side.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if schema is not None:
            yield pa.RecordBatch.from_pylist(picks(), schema=schema)

    return passing.mapInArrow(serve, candidates.schema).drop("turn", "rank")


def invite_suggestions(
    df: DataFrame,
    as_of: Column,
    geo: DataFrame | None = None,
    days_ahead: int = DAYS_AHEAD,
    top_n: int = PICKS_PER_EVENT,
    max_days_since_seen: float = MAX_DAYS_SINCE_SEEN,
    seed: int = 0,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Up to ``top_n`` random eligible people per upcoming event.

    Events are served by start; people not suggested to the calendar before come
    first. A seed repeats its picks.
    """
    keys = list(keys)
    past = history(df, as_of)
    metros = None if geo is None else metro_map(past, geo, keys)
    upcoming, eligible = _sides(df, as_of, metros, days_ahead, max_days_since_seen, keys)
    picked = served_in_order(drawn_candidates(upcoming, eligible, top_n, seed, keys), top_n, keys)
    return picked.join(last_event_with(past, keys), [*keys, "person"], "left")


def suggestions_by_event(suggestions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per event with its few suggested people as a list."""
    return suggestions.groupBy(
        *keys, "event_title", "event_start", F.coalesce("event_location", "region").alias("event_where")
    ).agg(F.sort_array(F.collect_list("person")).alias("people"))
