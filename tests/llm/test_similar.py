"""Near-duplicates by common shingles against brute force."""

import random

import corpus_pipeline
from datelore.llm.similar import drop_similar
from tests.llm.test_prints import plain_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_shingles(text, width=5):
    words = (text or "").translate(LOWER).encode().split()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1 if words else 0))}


def plain_survivors(texts, similarity=0.8):
    """Smallest ids of the components of all pairs of ``texts`` (by id) that are similar."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    holders = {}
    for i, s in sets.items():
        for x in s or {None}:
            holders.setdefault(x, []).append(i)
    met = {(a, b) for ids in holders.values() for a in ids for b in ids if b < a}
    pairs = [(a, b) for a, b in met if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity]
    group = plain_components(pairs, list(texts))
    return sorted(i for i in texts if group[i] == i)


def test_stage_drops_copies_down_to_four_fifths(spark):
    rng, texts = random.Random(5), {}
    for k in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 200, 900]))]
        texts[10 * k] = " ".join(words)
        for c in range(1, 4):
            copy = list(words)
            for at in rng.sample(range(len(words)), max(1, round(len(words) * rng.choice([0.005, 0.015, 0.022, 0.03])))):
                copy[at] = "changed"
            texts[10 * k + c] = " ".join(copy)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert found == plain_survivors(texts)
    assert 60 <= len(found) < 200


def test_chains_and_large_groups_are_whole(spark):
    rng = random.Random(6)
    words, texts = [f"w{rng.randrange(10**6)}" for _ in range(200)], {}
    for k in range(150):  # neighbours are near, the ends of the chain are not
        texts[k] = " ".join(words)
        words[rng.randrange(200)] = f"w{rng.randrange(10**6)}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert [r["doc_id"] for r in drop_similar(docs).collect()] == plain_survivors(texts) == [0]


def test_sample_equals_brute_force(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text")
    assert sorted(r["doc_id"] for r in drop_similar(docs).collect()) == plain_survivors({r["doc_id"]: r["text"] for r in docs.collect()})


def test_odd_rows(spark, odd, nothing, rows):
    """Nulls, empty and very long texts, repeated rows, null ids and clashing columns."""
    texts = {}
    for i, t, _, _ in rows:
        texts.setdefault(frozenset(plain_shingles(t)), set()).add((i is None, i or 0))
    clash = odd.withColumn("bits", odd["score"]).withColumn("labels", odd["copy"]).withColumn("leader", odd["row"])
    found = drop_similar(clash)
    assert found.columns == clash.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found.collect()) == sorted(min(ids) for ids in texts.values())
    assert drop_similar(nothing).count() == 0


def test_large_group_of_unlike_copies_leaves_few_rows(spark):
    """Copies of which no one is like all others are joined without a row for each pair."""
    rng = random.Random(9)
    words, texts = [f"w{rng.randrange(10**6)}" for _ in range(150)], {}
    for k in range(400):
        copy = list(words)
        for at in rng.sample(range(150), 3):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts[k] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in drop_similar(docs).collect()) == plain_survivors(texts)
