"""Language identification: held-out accuracy, calibration and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from datelore.llm import language as L
from datelore.llm.common import fold


def test_held_out_documents(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    held = fold("doc_id", 4) == 2
    model = L.fit_language_model(docs, ~held)
    found = L.identify_language(docs.filter(held), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert (model.weights == 0).mean() > 0.5


def test_labels_of_held_out_rows_play_no_part(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    held = fold("doc_id", 4) == 2
    spoilt = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    one, two = (sorted(map(tuple, L.identify_language(d, L.fit_language_model(d, ~held)).select("doc_id", "lang_pred", "score").collect())) for d in (docs, spoilt))
    assert one == two


def test_odd_rows(odd, nothing, rows):
    model = L.fit_language_model(odd, F.lit(True), settings=L.Settings(buckets=1 << 10))
    assert model.classes == ["en"]
    found = L.identify_language(odd, model).collect()
    assert len(found) == len(rows)
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert r["lang_pred"] == ("en" if letters else "und")
    empty = L.fit_language_model(nothing, F.lit(True))
    assert {r["lang_pred"] for r in L.identify_language(odd, empty).collect()} == {"und"}
    assert L.identify_language(nothing, model).count() == 0


def test_letters_are_letters():
    assert L.has_letter("12 é") and L.has_letter("漢")
    assert not any(map(L.has_letter, ("", "12_!", "x²"[1:], "Ⅷ ½")))


def test_grams_are_counted_alike_in_parts(monkeypatch):
    text = "Überall gäbe es viel zu zählen. " * 40
    whole = L.gram_counts(text, 1 << 12)
    monkeypatch.setattr(L, "CHARS_AT_ONCE", 64)
    assert (L.gram_counts(text, 1 << 12) == whole).all()
    assert whole.sum() == sum(len(f" {' '.join(text.lower().split())} ") - n for n in range(3))


def test_temperature_softens_wrong_certainty():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 400)
    logits = rng.normal(size=(400, 3))
    logits[np.arange(400), labels] += 1
    assert L.calibrated(10 * logits, labels) > 5
    assert abs(L.calibrated(10 * logits, labels) / L.calibrated(logits, labels) - 10) < 0.1


def test_weights_equal_the_plain_method():
    """Follow-the-regularised-leader written out number by number, with the same order of rows."""
    rng = np.random.default_rng(3)
    s = L.Settings(buckets=16, epochs=2, l1=0.6, l2=0.1)
    rows = [(np.sort(rng.choice(16, 5, replace=False)), rng.random(5)) for _ in range(30)]
    labels = rng.integers(0, 3, 30).tolist()
    z, n = [[0.0] * 3 for _ in range(17)], [[0.0] * 3 for _ in range(17)]

    def weight(i, c):
        l1 = 0.0 if i == 16 else s.l1
        if abs(z[i][c]) <= l1:
            return 0.0
        sign = 1 if z[i][c] > 0 else -1
        return -(z[i][c] - sign * l1) / ((s.beta + math.sqrt(n[i][c])) / s.alpha + s.l2)

    order = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for k in order.permutation(30):
            row = [*zip(rows[k][0].tolist(), rows[k][1].tolist()), (16, 1.0)]
            w = {i: [weight(i, c) for c in range(3)] for i, _ in row}
            logits = [sum(v * w[i][c] for i, v in row) for c in range(3)]
            total = sum(map(math.exp, logits))
            for i, v in row:
                for c in range(3):
                    g = v * (math.exp(logits[c]) / total - (labels[k] == c))
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / s.alpha
                    z[i][c] += g - sigma * w[i][c]
                    n[i][c] += g * g
    weights, bias = L.follow_the_leader(rows, labels, 3, s)
    assert np.allclose(np.vstack([weights, bias]), [[weight(i, c) for c in range(3)] for i in range(17)], atol=1e-12)
    assert (weights == 0).any()


def test_copies_of_a_row_are_drawn_once(spark, monkeypatch):
    """A row that stands thousands of times is one row of the sample, and long texts stay within the bytes allowed."""
    seen = []
    fitted = L.follow_the_leader
    monkeypatch.setattr(L, "follow_the_leader", lambda rows, labels, *rest: seen.append(len(rows)) or fitted(rows, labels, *rest))
    copies = spark.range(5000).selectExpr("7L as doc_id", "'ein und das selbe mal' as text", "'de' as lang")
    others = spark.range(50).selectExpr("id + 10 as doc_id", "concat('the same words ', id) as text", "'en' as lang")
    model = L.fit_language_model(copies.union(others), F.lit(True), settings=L.Settings(sample_per_class=30))
    assert seen == [31 - len([k for k in range(31) if k % 5 == 0])] and model.classes == ["de", "en"]
    L.fit_language_model(copies.union(others), F.lit(True), settings=L.Settings(sample_per_class=30, sample_bytes=8000))
    assert seen[1] < seen[0] / 2
    with pytest.raises(ValueError):
        L.fit_language_model(others, F.lit(True), settings=L.Settings(classes=0))
