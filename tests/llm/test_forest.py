"""Near-duplicates by the forest of min-hash orders against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from datelore.llm import forest as module
from datelore.llm.forest import Forest, group_links, near_copies, neighbours
from datelore.llm.queries import QUERIES
from tests.llm.test_prints import plain_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, width=3):
    words = (text or "").translate(LOWER).encode().split()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1 if words else 0))}


def plain_near(rows, percent=85):
    """(id, n_shingles, component) for (id, text) rows with ids that differ."""
    sets = {i: plain_set(t) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = []
    for i, s in sets.items():
        common = {}
        for x in s:
            for o in holders[x]:
                if o < i:
                    common[o] = common.get(o, 0) + 1
        pairs += [(i, o) for o, n in common.items() if 100 * n >= percent * (len(s) + len(sets[o]) - n)]
    group = plain_components(pairs, list(sets))
    return sorted((i, len(sets[i]), group[i], group[i] == i) for i in sets)


def test_query_equals_brute_force(spark, sample):
    docs = [tuple(r) for r in spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_minhash_forest"](spark, sample).collect()) == plain_near(docs)


def edited(rng, words, share):
    copy = list(words)
    for at in rng.sample(range(len(words)), max(1, round(len(words) * share))):
        copy[at] = f"x{rng.randrange(10**6)}"
    return copy


@pytest.mark.parametrize("held, room", [(1 << 18, 64), (2000, 4)])
def test_large_groups_and_borders(spark, monkeypatch, held, room):
    """Copies near 0.85, chains of them, and one large group, also where regions are refined and cut into blocks."""
    monkeypatch.setattr(module, "HELD", held)
    monkeypatch.setattr(module, "ROOM", room)
    rng, rows = random.Random(8), {}
    for k in range(25):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([20, 90, 300]))]
        for c in range(4):
            rows[100 * k + c] = " ".join(words if c == 0 else edited(rng, words, rng.choice([0.01, 0.02, 0.025, 0.03])))
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for c in range(90):
        rows[5000 + c] = " ".join(edited(rng, words, 0.022))
    for c in range(40):
        words = edited(rng, words, 0.02)
        rows[6000 + c] = " ".join(words)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    found = sorted(tuple(r) for r in near_copies(docs).collect())
    assert found == plain_near(list(rows.items()))
    assert 30 < sum(r[3] for r in found) < 200


def test_odd_rows(odd, nothing, rows):
    found = near_copies(odd.withColumn("kept", F.lit("mine"))).collect()
    assert len(found) == len(rows) and near_copies(nothing).count() == 0
    by_text = {}
    for i, t, _, _ in rows:
        by_text.setdefault(frozenset(plain_set(t)), []).append(i)
    for r in found:
        assert r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"])
        assert r["n_shingles"] or r["component_id"] == r["doc_id"]
    wanted = sorted((len(s), min((i for i in ids if i is not None), default=-1)) for s, ids in by_text.items() if s for _ in ids)
    assert sorted((r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in found if r["n_shingles"]) == wanted


def test_neighbours_are_those_of_the_whole_order(spark):
    forest, rng = Forest(3, 2, 4), np.random.default_rng(4)
    labels = rng.integers(0, 4, (300, 3)) << 27 | rng.integers(0, 3, (300, 3)) << 18 | rng.integers(0, 3, (300, 3)) << 9 | rng.integers(0, 2, (300, 3))
    nodes = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(labels)], "node long, labels array<long>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {(r["tree"], r["node"]): r for r in neighbours(nodes, forest).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    missing = 0
    for tree in range(3):
        order = sorted((label, i) for i, label in enumerate(labels[:, tree].tolist()))
        for (x, a), (y, b) in zip(order, order[1:]):
            depth = next((d for d in range(4, -1, -1) if x >> 9 * (4 - d) == y >> 9 * (4 - d)), 0)
            if depth >= 2:
                row = found[tree, a]
                missing += row["after"] != b
                assert row["after"] in (b, None) and (row["after"] is None or row["after_lcp"] == depth)
    assert missing <= 24  # at the borders of ranges
    assert forest.miss(1.0) == 0


def test_groups_leave_forests():
    rng = random.Random(1)
    base = [rng.randrange(1 << 60) for _ in range(200)]
    sets = [np.unique(np.array([x if rng.random() > 0.06 else rng.randrange(1 << 60) for x in base], np.uint64)) for _ in range(40)]
    a, b = group_links(sets, np.arange(40), np.ones(40, bool), -1, 850)
    near = [(i, j) for i in range(40) for j in range(i) if (n := len(np.intersect1d(sets[i], sets[j]))) * 1000 >= 850 * (len(sets[i]) + len(sets[j]) - n)]
    assert plain_components(list(zip(a.tolist(), b.tolist())), list(range(40))) == plain_components(near, list(range(40)))
    assert len(a) < 40 and set(zip(a.tolist(), b.tolist())) <= {p for i, j in near for p in ((i, j), (j, i))}
