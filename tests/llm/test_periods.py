"""Periodic runs against their definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from datelore.llm.periods import maximal_runs, periodic_runs
from datelore.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"


def plain_words(text):
    for c in WHITE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_runs(words, least):
    """All maximal stretches for every period, the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        t = 0
        while t + q < n:
            if words[t] != words[t + q]:
                t += 1
                continue
            s = t
            while t + q < n and words[t] == words[t + q]:
                t += 1
            if t - s + q >= max(least, 2 * q):
                found.setdefault((s, t - s + q), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sequences():
    rng, a, b = random.Random(1), [0], [0, 1]
    while len(b) < 150:
        a, b = b, b + a
    yield b
    yield from ([], [0], [0] * 90, [0, 1] * 30 + [1, 0] * 30, ([0] * 40 + [1]) * 4, ([0] * 30 + [1] + [0] * 9) * 3)
    for _ in range(300):
        n, k = rng.randint(0, 120), rng.choice([1, 2, 2, 3, 6])
        x = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            at = rng.randrange(n)
            p = rng.randint(1, n - at)
            x = x[:at] + [x[at + i % p] for i in range(n - at)]
        yield x + x[::-1] if rng.random() < 0.3 else x


def test_runs_equal_their_definition():
    for x in sequences():
        for least in (2, 12):
            found = list(zip(*(a.tolist() for a in maximal_runs(np.array(x, np.int64), least))))
            assert found == sorted(plain_runs(x, least), key=lambda r: (r[0], r[2]))


def test_long_texts_of_one_word():
    start, length, period = maximal_runs(np.zeros(300_000, np.int64), 12)
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [300_000], [1])


def test_odd_rows(spark, odd, nothing, rows):
    texts = [t for _, t, _, _ in rows] + ["la " * 40, "a b\tc " * 9 + "end", "é ü " * 8]
    more = odd.unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(texts[-3:])], "doc_id long, text string"), allowMissingColumns=True).withColumn("Runs", F.lit("mine"))
    found = periodic_runs(more).collect()
    assert "Runs" not in found[0].__fields__ and len(found) == len(texts)
    wanted = []
    for t in texts:
        words = plain_words(t or "")
        runs = sorted(plain_runs(words, 12), key=lambda r: (r[0], r[2])) if len(words) < 5000 else []
        wanted.append((t or "", len(words), runs, plain_collapsed(words, runs)))
    assert sorted((r["text"] or "", r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found) == sorted(wanted)
    assert periodic_runs(nothing).count() == 0


@pytest.fixture(scope="module")
def answered(spark, sample):
    return {r["doc_id"]: r.asDict() for r in QUERIES["op12_periodic_runs"](spark, sample).collect()}


def test_query_equals_brute_force(spark, sample, answered):
    docs, seen = spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text").collect(), 0
    assert len(docs) == len(answered)
    for doc_id, text in docs:
        words = plain_words(text or "")
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if len(words) > 600:
            continue
        runs = sorted(plain_runs(words, 12), key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        seen += bool(runs)
        assert answered[doc_id] == {
            "doc_id": doc_id,
            "n_runs": len(runs),
            "start": best[0],
            "length": best[1],
            "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest(),
        }
    assert seen > 5
