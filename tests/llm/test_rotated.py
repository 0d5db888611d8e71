"""Nearest vectors against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from datelore.llm import rotated


def plain(vectors, asked, k=10):
    out = {}
    for q in asked:
        rest = sorted((math.dist(vectors[q], v), i) for i, v in vectors.items() if i != q)
        out[q] = [i for _, i in rest[:k]]
    return out


def test_recall_and_scores(spark, sample):
    df = spark.read.parquet(f"{sample}/embeddings.parquet")
    vectors = {r["vec_id"]: list(r["embedding"]) for r in df.collect()}
    found = rotated.nearest(df, F.col("vec_id") % 20 == 0).collect()
    wanted = plain(vectors, [i for i in vectors if i % 20 == 0])
    hits = sum(r["vec_id"] in wanted[r["query_id"]] for r in found)
    assert hits >= 0.9 * sum(map(len, wanted.values())) and len(found) == sum(map(len, wanted.values()))
    assert all(math.isclose(r["score"], math.dist(vectors[r["query_id"]], vectors[r["vec_id"]]), rel_tol=1e-12) for r in found)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((2000, 64)).astype(np.float32)
    q, _ = np.linalg.qr(rng.standard_normal((64, 64)))
    rotation = rotated.Rotation(64, vectors.mean(axis=0).astype(float), q, 3.0)
    norms, turned = rotation.turned(vectors)
    codes, inner = np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / 8
    outside = 0
    for i in range(20):
        low, high = rotated.bounds(rotation, turned[i], norms[i], codes, np.stack([norms, inner], axis=1))
        true = ((vectors.astype(float) - vectors[i].astype(float)) ** 2).sum(axis=1)
        outside += ((true < low) | (true > high)).sum()
    assert outside <= 0.002 * 20 * 2000


def test_odd_vectors_ties_and_few_rows(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 4), 1.0, 0.0]) for i in range(40)]
    rows += [(100, None), (200, []), (300, [0.0, 0.0, 0.0]), (400, [nan, 1.0, 1.0]), (500, [1.0, None, 1.0]), (600, [inf, 1.0, 1.0]), (700, [1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(0, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(3)
    vectors = dict(rows[:40])
    for block in (4096, 5):
        monkeypatch.setattr(rotated, "BLOCK", block)
        found = {}
        for r in rotated.nearest(df.filter("vec_id <> 0"), F.col("vec_id") % 10 == 0, k=10).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert found == plain({i: v for i, v in vectors.items() if i}, [10, 20, 30])
    few = rotated.nearest(df.filter("vec_id in (1, 2, 3)"), F.lit(True), k=10)
    assert few.groupBy("query_id").count().filter("count = 2").count() == 3
    assert {r["vec_id"] for r in rotated.nearest(df, F.col("vec_id") == 0, k=3).collect()}.isdisjoint({0})
    assert rotated.nearest(df.limit(0), F.lit(True)).count() == 0


def test_repeated_query_rows_ask_once(spark, monkeypatch):
    """Rows that repeat, also the query's own, and an id with several vectors."""
    monkeypatch.setattr(rotated, "BLOCK", 4)
    rows = [(i, [float(i), 1.0]) for i in range(30)]
    again = rows[:1] * 3 + rows[5:6] + [(0, None), (0, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows + again, "vec_id long, embedding array<double>").repartition(4)
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rotated.nearest(df, F.col("vec_id") % 20 == 0, k=6).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in found if r[0] == 0] == [(0, i + 1, v) for i, v in enumerate([1, 2, 3, 4, 5, 5])]
    assert [r[2] for r in found if r[0] == 20] == [19, 21, 18, 22, 17, 23]
    several = df.filter("vec_id <> 0").union(spark.createDataFrame([(0, [9.5, 1.0]), (0, [3.0, 1.0])], df.schema))
    assert [r["vec_id"] for r in rotated.nearest(several, F.col("vec_id") == 0, k=3).orderBy("rank").collect()] == [3, 2, 4]
