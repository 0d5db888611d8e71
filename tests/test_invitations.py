"""Rings of people and the order of serving, against the rules read one by one."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from datelore.operators.reconnect import drawn_candidates, ring_candidates, served_in_order

T0 = dt.datetime(2024, 8, 1)
UPCOMING = "owner int, event_id string, event_title string, event_category string, event_start timestamp_ntz, event_location string, _guests array<string>, region string"
ELIGIBLE = "owner int, event_category string, person string, days_since_seen double, _usual string"


def digest(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def plain(upcoming, eligible, top_n, seed):
    """Every event's picks, event by event."""
    out, known = {}, {}
    for owner, event, _, category, start, _, guests, region in sorted(upcoming, key=lambda e: (e[0], e[4], e[1])):
        ring = [p for o, c, p, _, usual in eligible if (o, c) == (owner, category) and (region is None or usual == region)]
        ring.sort(key=lambda p: (digest(seed, p), p))
        if not ring:
            continue
        at = int(digest(seed, event)[:13], 16) % len(ring)
        asked = [p for p in ring[at:] + ring[:at] if p not in guests]
        met = known.setdefault(owner, set())
        picks = ([p for p in asked if p not in met] + [p for p in asked if p in met])[:top_n]
        met.update(picks)
        out.update({(owner, event, p): True for p in picks})
    return sorted(out)


@pytest.mark.parametrize("keys", [["owner"], []])
def test_picks_equal_the_rule_read_event_by_event(spark, keys):
    rng = random.Random(len(keys))
    owners = [0, 1, 2] if keys else [0]
    people = [f"p{i}" for i in range(23)]
    eligible = [(o, c, p, 1.0, rng.choice([None, "here", "there"])) for o in owners for c in "xy" for p in people if rng.random() < 0.7]
    upcoming = [
        (o, f"e{k}", "t", rng.choice("xyz"), T0 + dt.timedelta(hours=rng.randrange(20)), "l", rng.sample(people, rng.choice([0, 3, 20])), rng.choice([None, "here", "nowhere"]))
        for o in owners
        for k in range(30)
    ]
    a, b = spark.createDataFrame(upcoming, UPCOMING), spark.createDataFrame(eligible, ELIGIBLE)
    if not keys:
        a, b = a.drop("owner"), b.drop("owner")
    for top_n in (1, 4):
        candidates = ring_candidates(a, b, top_n, 5, keys)
        found = served_in_order(candidates, top_n, keys).collect()
        assert sorted((r["owner"] if keys else 0, r["event_id"], r["person"]) for r in found) == plain(upcoming, eligible, top_n, 5)
        for r in candidates.groupBy(*keys, "event_id", "turn").count().collect():
            assert r["count"] <= top_n * r["turn"] + 20


def test_rows_follow_events_and_not_people(spark):
    """Thousands of people and of events in one calendar: early events see few people, and one pass serves all."""
    eligible = spark.range(3000).select(F.lit("x").alias("event_category"), F.concat(F.lit("p"), "id").alias("person"), F.lit(1.0).alias("days_since_seen"), F.lit(None).cast("string").alias("_usual"))
    start = F.lit("2024-08-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") / 40).cast("int"))
    upcoming = spark.range(600).select(F.concat(F.lit("e"), "id").alias("event_id"), F.lit("t").alias("event_title"), F.lit("x").alias("event_category"), start.alias("event_start"), F.lit("l").alias("event_location"), F.array().cast("array<string>").alias("_guests"), F.lit(None).cast("string").alias("region"))
    candidates = ring_candidates(upcoming, eligible, 5, 1)
    assert candidates.count() == sum(min(3000, 5 * j) for j in range(1, 601))
    picked = served_in_order(candidates, 5)
    sums = picked.agg(F.count("*").alias("n"), F.countDistinct("person").alias("people")).first()
    assert (sums["n"], sums["people"]) == (3000, 3000)


def test_every_event_draws_from_all_its_people(spark):
    """Each event has an order of its own over everyone eligible, which a ring of people does not give; events with one id are two events."""
    rng = random.Random(3)
    people = [f"p{i}" for i in range(23)]
    eligible = [(o, c, p, 1.0, rng.choice([None, "here", "there"])) for o in (0, 1) for c in "xy" for p in people if rng.random() < 0.7]
    upcoming = [
        (o, f"e{k}", "t", rng.choice("xyz"), T0 + dt.timedelta(hours=rng.randrange(20)), "l", rng.sample(people, rng.choice([0, 3, 20])), rng.choice([None, "here", "nowhere"]))
        for o in (0, 1)
        for k in range(30)
    ]
    upcoming += [(2, "e", "t", "x", T0, "l", [], None)] * 2
    eligible += [(2, "x", p, 1.0, None) for p in people]
    expected, known = [], {}
    for owner, event, _, category, _, _, guests, region in sorted(upcoming, key=lambda e: (e[0], e[4], e[1])):
        asked = [p for o, c, p, _, usual in eligible if (o, c) == (owner, category) and (region is None or usual == region) and p not in guests]
        asked.sort(key=lambda p: (digest(5, event, p), p))
        met = known.setdefault(owner, set())
        picks = ([p for p in asked if p not in met] + [p for p in asked if p in met])[:4]
        met.update(picks)
        expected += [(owner, event, p) for p in picks]
    candidates = drawn_candidates(spark.createDataFrame(upcoming, UPCOMING), spark.createDataFrame(eligible, ELIGIBLE), 4, 5, ["owner"])
    found = served_in_order(candidates, 4, ["owner"]).collect()
    assert sorted((r["owner"], r["event_id"], r["person"]) for r in found) == sorted(expected)
