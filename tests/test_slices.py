"""Prefix scans over ranges, with half of all rows at one moment."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from datelore.operators.sequences import in_slices, nearest, stays
from tests.test_operators import sequential_stays

MIDNIGHT = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small ranges are not joined to larger ones here, as they are where there is little to do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def crowded(spark):
    """Rows of three calendars, most of one, half of them at its midnight."""
    rng, rows = random.Random(4), []
    for k in range(6000):
        start = MIDNIGHT if k % 2 else MIDNIGHT + dt.timedelta(minutes=rng.randrange(-90_000, 90_000))
        owner = 0 if k % 2 or k % 10 else rng.choice([1, 2])
        rows.append((owner, f"e{k:05d}", rng.choice(["x", "y", None, "x"]), start, start + dt.timedelta(minutes=rng.choice([0, 30, 900]))))
    return rows, spark.createDataFrame(rows, "owner long, id string, place string, start timestamp_ntz, end timestamp_ntz").repartition(5)


def test_no_range_is_much_larger_than_the_others(spark, crowded):
    _, df = crowded
    for order in (["owner", "start", "id"], ["owner", "start"], ["owner"]):  # also where the order cannot tell rows apart
        dealt = in_slices(df, order)
        sizes = [r["count"] for r in dealt.groupBy("_slice").count().collect()]
        assert sum(sizes) == 6000 and len(sizes) == 8 and max(sizes) <= 2 * 6000 / 8
        ends = dealt.groupBy("_slice").agg(F.min(F.struct(*order)).alias("a"), F.max(F.struct(*order)).alias("b")).orderBy("_slice").collect()
        assert all(tuple(x["b"]) <= tuple(y["a"]) for x, y in zip(ends, ends[1:]))


def test_stays_across_ranges(spark, crowded):
    rows, df = crowded
    for gap in (0.05, 3):
        got = [tuple(r) for r in stays(df, ["owner"], "place", gap).drop("duration_days").collect()]
        assert sorted(got, key=repr) == sequential_stays(rows, gap)


def test_nearest_across_ranges(spark, crowded):
    rows, df = crowded
    rng = random.Random(6)
    seen = [(rng.choice([0, 0, 1, 2]), j, MIDNIGHT + dt.timedelta(minutes=rng.choice([0, rng.randrange(-90_000, 90_000)]))) for j in range(400)]
    right = spark.createDataFrame(seen, "owner long, j long, seen timestamp_ntz")
    found = nearest(df.select("owner", "id", "start"), right, ["owner"], "start", "seen", F.col("j"), 1.0).collect()
    by_owner = {}
    for owner, j, at in seen:
        by_owner.setdefault(owner, []).append((at, j))
    wanted = {}
    for owner, id_, _, start, _ in rows:
        gap, j = min((abs(at - start), j) for at, j in by_owner[owner])
        if gap <= dt.timedelta(days=1):
            wanted[id_] = (j, gap // dt.timedelta(microseconds=1))
    assert {r["id"]: (r["match"]["j"], r["gap_micros"]) for r in found} == wanted and len(found) == len(wanted)
