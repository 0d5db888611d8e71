"""Divergence of sources against its definition."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from datelore.llm import divergence
from datelore.llm.divergence import pair_sums, shares, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs=10, top=10):
    rows = [[x or "" for x in r] for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, groups = Counter(), {s: Counter() for _, a, s in rows if a == lang}
        for text, a, s in rows:
            if a == lang:
                terms = TERM.findall(text.translate(LOWER))
                docs.update(set(terms))
                groups[s].update(terms)
        kept = sorted(t for t in docs if docs[t] >= min_docs)
        whole = sum(groups.values(), Counter())

        total = {id(c): sum(c[t] for t in kept) for c in [*groups.values(), whole]}

        def p(n, counts):
            return 1 + 10**9 * (n + 2) // (total[id(counts)] + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s, counts in groups.items():
            pairs = [(o, sum(f(p(counts[t], counts), p(more[t], more)) for t in kept)) for o, more in groups.items() if o != s]
            own = [(t, p(counts[t], counts), p(whole[t], whole)) for t in kept if counts[t]]
            terms = [(t, f(a, b)) for t, a, b in own if a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[: top if part == "term" else None]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in source_divergence(df, **more).collect())


def test_odd_rows(odd, nothing, rows):
    for least in (1, 2, 10, 1000):
        assert found(odd.withColumn("item", F.lit("mine")), min_docs=least, top=3) == plain([r[1:] for r in rows], least, 3)
    assert found(nothing) == []


def test_blocks_and_small_tables_add_up(spark, sample, monkeypatch):
    docs = spark.read.parquet(f"{sample}/documents.parquet").select("text", "lang", "source")
    wanted = plain([tuple(r) for r in docs.collect()], 3)
    monkeypatch.setattr(divergence, "BLOCK", 20)
    assert found(docs, min_docs=3) == wanted
    assert any(r[2] == "pair" for r in wanted) and any(r[2] == "term" for r in wanted)


def test_shares_of_huge_counts_are_exact():
    n = np.array([0, 7, 10**13], np.int64)
    assert shares(n, 3 * 10**13).tolist() == [1 + 10**9 * (x + 2) // (3 * 10**13) for x in n.tolist()]


def test_runs_of_both_columns_equal_all_rows():
    rng = np.random.default_rng(2)
    counts, times = rng.integers(0, 3, (200, 4)), rng.integers(1, 5, 200)
    divisors = [int(d) for d in rng.integers(50, 90, 4)]
    got = pair_sums(counts, times, divisors)
    for i in range(4):
        for j in range(4):
            p, q = shares(counts[:, i], divisors[i]), shares(counts[:, j], divisors[j])
            assert got[i, j] == ((p - q) ** 2 // (p + q) * times).sum()
