"""Context-tree weighting against its definition, and scores against plain counts."""

import math
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from datelore.llm import lmscore
from datelore.llm.contexttree import EDGE, ContextTree, grams


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_tree(texts, depth):
    """P(byte | context) by the textbook recursion, all contexts being nodes."""
    counts = Counter()
    for t in texts:
        padded = bytes([EDGE]) * depth + t + bytes([EDGE])
        for i in range(depth, len(padded)):
            for d in range(depth + 1):
                for j in range(8):
                    counts[padded[i - d : i], (1 << j) | (padded[i] >> (8 - j)), (padded[i] >> (7 - j)) & 1] += 1

    def kt(a, b):
        return math.exp(math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1))

    contexts = {c for c, _, _ in counts}

    def weighted(context, node, extra=()):
        n = [counts[context, node, bit] + sum(1 for c, v, b in extra if (c, v, b) == (context, node, bit)) for bit in (0, 1)]
        if len(context) == depth:
            return kt(*n)
        children = {c for c in contexts if len(c) == len(context) + 1 and c.endswith(context)} | {c for c, v, _ in extra if len(c) == len(context) + 1 and c.endswith(context)}
        return 0.5 * kt(*n) + 0.5 * math.prod(weighted(c, node, extra) for c in children)

    def chance(context, byte):
        p = 1.0
        for j in range(8):
            node, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
            extra = [(context[len(context) - d :], node, bit) for d in range(depth + 1)]
            p *= weighted(b"", node, extra) / weighted(b"", node)
        return p

    return chance


def tree_of(texts, depth, least=0):
    keys, _ = grams(texts, depth)
    rows = []
    for d in range(depth + 1):
        found, n = np.unique((((keys >> 8) & ((1 << 8 * d) - 1)) << 8) | (keys & 255), return_counts=True)
        total = Counter()
        for k, m in zip(found.tolist(), n.tolist()):
            total[k >> 8] += m
        rows += [(d, k >> 8, k & 255, m) for k, m in zip(found.tolist(), n.tolist()) if total[k >> 8] >= least]
    return ContextTree(depth, *[np.array(c, np.int64) for c in zip(*rows)])


def test_tree_is_context_tree_weighting():
    texts = [b"abracadabra", b"banana", b"", b"cab"]
    tree, plain = tree_of(texts, 2), plain_tree(texts, 2)
    # A context never met keeps its parent's other contexts together, which are none here.
    for context, byte in product([b"ab", b"an", b"\xff\xff", b"\xffb"], [*b"abcnd", EDGE, 0]):
        key = (int.from_bytes(context, "big") << 8) | byte
        assert math.isclose(tree.log10(np.array([key]))[0], math.log10(plain(context, byte)), rel_tol=1e-5)


def test_chances_sum_to_one_with_few_nodes_and_new_contexts():
    texts = [bytes(f"some text number {i} of many, {i * i}", "utf8") for i in range(60)]
    for least in (0, 20, 400):
        tree = tree_of(texts, 3, least)
        for context in (b"tex", b"zzz", b"\xff\xff\xff", b" 12"):
            keys = (int.from_bytes(context, "big") << 8) + np.arange(256)
            assert math.isclose((10 ** tree.log10(keys)).sum(), 1, rel_tol=1e-5)


def test_scores_are_sums_over_texts():
    tree = tree_of([b"hello world", b"held"], 3)
    assert np.allclose(tree.score([b"hello", b"", b"hold"]), [tree.log10(grams([t], 3)[0]).sum() for t in (b"hello", b"", b"hold")])
    assert tree.score([b"hello world"])[0] > tree.score([b"ld howorell"])[0]
    assert len(tree.score([])) == 0


def test_base_scores_and_odd_rows(odd, rows, nothing, monkeypatch):
    learn = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [[*(r[1] or "").translate(low).encode().split(), None] for r in rows]
    seen = Counter(w for r, ws in zip(rows, words) if r[0] is None or r[0] % 5 != 1 for w in ws)
    total, distinct = seen.total(), len(seen)
    base = [sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws) for ws in words]
    wanted = sorted((r[0] is None, r[0] or 0, len(ws), sum(seen[w] > 0 for w in ws), total, round(b, 6)) for r, ws, b in zip(rows, words, base))
    for frequent in (8, 1 << 16):
        model = lmscore.fit(odd, learn, depth=4, frequent=frequent)
        found = lmscore.score_texts(odd, model).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == wanted
        assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in found)
    assert lmscore.score_texts(nothing, model).count() == 0
    blank = lmscore.score_texts(odd, lmscore.fit(nothing, F.lit(True))).collect()
    assert {r["n_known"] for r in blank} == {0} and all(math.isclose(r["bits_per_byte"], 8, rel_tol=1e-6) for r in blank)


def test_counts_do_not_depend_on_parts(odd, monkeypatch):
    def counted(rows, buckets):
        found = lmscore.merged_buckets(lmscore.gram_counts(rows, "text", 3, buckets))
        return sorted(x for r in found.collect() for x in zip(lmscore.unpacked_grams(r["grams"]).tolist(), lmscore.unpacked(r["n"], "<i8").tolist()))

    whole = counted(odd, 1)
    keys, n = np.unique(grams([(r["text"] or "").translate(LOWER).encode() for r in odd.collect()], 3)[0], return_counts=True)
    assert whole == list(zip(keys.tolist(), n.tolist()))
    assert counted(odd.repartition(9), 5) == whole
    monkeypatch.setattr(lmscore, "HELD", 50)
    assert counted(odd.repartition(2), 3) == whole


def test_spark_scores_equal_the_plain_recursion(spark, monkeypatch):
    """Every context stands twice, so every context is a node of the textbook's tree."""
    texts = ["abracadabra", "banana band", "cab", "bandana"] * 2
    plain = plain_tree([t.encode() for t in texts], 4)
    asked = ["abra", "banana", "", "abracadabra band"]

    def score(text):
        padded = bytes([EDGE]) * 4 + text.encode() + bytes([EDGE])
        chance = [plain(padded[i - 4 : i], padded[i]) for i in range(4, len(padded))]
        return None if min(chance) <= 0 else sum(map(math.log10, chance))

    monkeypatch.setattr(lmscore, "BUCKET_BYTES", 20)
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 10)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + asked)], "doc_id long, text string").repartition(3)
    model = lmscore.fit(docs, F.col("doc_id") < len(texts), depth=4)
    found = {r["text"]: r["score"] for r in lmscore.score_texts(docs, model).join(docs.withColumnRenamed("doc_id", "i"), F.col("doc_id") == F.col("i")).collect()}
    for t in {*texts, "abra", "banana", ""}:
        assert math.isclose(found[t], score(t), rel_tol=1e-6), t


def test_branches_equal_the_whole_tree(spark, sample, monkeypatch):
    """Buckets, blocks and levels in Spark give what one tree of all nodes gives, and nodes grow with the corpus."""
    monkeypatch.setattr(lmscore, "BUCKET_BYTES", 40_000)
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 30_000)
    docs = spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: (r["text"] or "").translate(LOWER).encode() for r in docs.collect()}
    nodes = []
    for least in (150, 50):
        model = lmscore.fit(docs, F.col("doc_id") >= least)
        whole = tree_of([t for i, t in texts.items() if i >= least], 6, 2)
        found = {r["doc_id"]: r["score"] for r in lmscore.score_texts(docs, model).select("doc_id", "score").collect()}
        wanted = dict(zip(texts, whole.score(list(texts.values())).tolist()))
        assert len(found) == len(wanted) and all(math.isclose(found[i], w, rel_tol=1e-6) for i, w in wanted.items())
        held = [lmscore.branch(6, lmscore.unpacked_grams(r["grams"]), lmscore.unpacked(r["n"], "<i8")) for r in model.branches.collect()]
        nodes.append(sum(len(level.contexts) for tree in held for level in tree.levels[3:]))
        assert nodes[-1] + sum(len(level.contexts) for level in model.top) == sum(len(level.contexts) for level in whole.levels)
    assert nodes[1] > 1.5 * nodes[0]


def test_memory_of_a_tree_follows_its_nodes():
    """Grams are worked out some at a time, with the same logarithms as all together."""
    import tracemalloc

    from datelore.llm import contexttree
    from datelore.llm.lmscore import branch

    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(97, 123, (400_000, 7)) @ (256 ** np.arange(7)))
    tree = branch(0, keys & 0xFF, np.full(len(keys), 2), [])
    some = tree._worked_out(keys[:1000] & 0xFF)
    tracemalloc.start()
    found = tree.log10(keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(found[:1000], some) and contexttree.AT_ONCE < len(keys)
    assert peak < 300 * len(keys)


def test_trees_of_a_bucket_take_less_than_one_of_all_its_branches(monkeypatch):
    """Trees of some branches each: the same logarithms, also of grams and branches never met, and no more at once than a few branches take."""
    import tracemalloc

    rng = np.random.default_rng(2)
    keys, n = np.unique(rng.integers(97, 105, (300_000, 7)) @ (256 ** np.arange(7)), return_counts=True)
    asked = np.unique(np.append(keys[::3], rng.integers(96, 106, (20_000, 7)) @ (256 ** np.arange(7))))
    whole = tree_of([b"abc", b"hgfedcba", b"hhh"], 3)
    top = whole.levels[:3]
    peaks, found = [], []
    for make in (lmscore.branch, lambda *x: lmscore.Branches(*x)):
        tracemalloc.start()
        trees = make(6, keys, n, top)
        trees.log10(keys)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        found.append((trees.log10(keys), trees.log10(asked)))
    assert all(np.array_equal(a, b) for a, b in zip(*found))
    assert len(trees.trees) > 3 and peaks[1] < 0.75 * peaks[0] and peaks[1] < 450 * len(keys)
    runs = [at for _, at in lmscore.by_branches(keys, 6)]
    assert np.array_equal(np.sort(np.concatenate(runs)), np.arange(len(keys)))
    assert len({e for at in runs for e in {*lmscore.endings(keys[at], 6).tolist()}}) == sum(len({*lmscore.endings(keys[at], 6).tolist()}) for at in runs)
    monkeypatch.setattr(lmscore, "TREE_GRAMS", 10)  # less than a branch
    some = keys[:3000]
    assert np.allclose(lmscore.Branches(6, some, n[:3000], top).log10(asked), lmscore.branch(6, some, n[:3000], top).log10(asked), rtol=1e-12, atol=0)
    assert len(lmscore.Branches(6, keys[:0], n[:0], top).log10(asked)) == len(asked)


def test_places_take_few_bytes_a_number_while_they_are_found():
    import tracemalloc

    numbers = np.random.default_rng(3).permutation(1 << 21).astype(np.int64)[: 13 << 17] * 977
    tracemalloc.start()
    places = lmscore.Places(numbers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(places.of(numbers[::-7]), np.arange(len(numbers))[::-7])
    assert peak < 30 * len(numbers)


def test_gamma_of_common_counts_is_looked_up(monkeypatch):
    """Nodes have the same few counts over and over: only those beyond the table are worked out, and to the same numbers."""
    from datelore.llm import contexttree

    rng = np.random.default_rng(4)
    zeros, ones = (rng.integers(0, contexttree.COUNTS, 30_000) // rng.integers(1, 2000, 30_000) * 1.0 for _ in range(2))
    zeros[:9] *= 10_000
    zeros[9:12], ones[9:12] = (contexttree.COUNTS - 1, contexttree.COUNTS, 0), (0, 0, contexttree.COUNTS)
    plain, worked, many = contexttree.log_gamma, [], zeros + ones >= contexttree.COUNTS
    wanted = plain(zeros + 0.5) + plain(ones + 0.5) - np.log(np.pi) - plain(zeros + ones + 1)
    contexttree.log_block(zeros, ones)
    monkeypatch.setattr(contexttree, "log_gamma", lambda x: worked.append(np.size(x)) or plain(x))
    assert np.allclose(contexttree.log_block(zeros, ones), wanted, rtol=1e-13, atol=1e-13)
    assert 0 < many.sum() < 100 and sum(worked) == 3 * many.sum()


def test_grams_are_bytes_with_those_before():
    texts = [b"abc", b"", b"\xc3\xa9t\xc3\xa9", b"a" * 20, b""]
    for depth in range(8):
        for some in (texts, texts[1:2], []):
            wanted = []
            for t in some:
                padded = bytes([EDGE]) * depth + t + bytes([EDGE])
                wanted += [int.from_bytes(padded[i : i + depth + 1], "big") for i in range(len(t) + 1)]
            keys, sizes = grams(some, depth)
            assert keys.dtype == np.int64 and keys.view(np.uint64).tolist() == wanted and sizes.tolist() == [len(t) + 1 for t in some]


def test_words_of_a_batch_are_split_together():
    """As bytes.split tells them, in any part of a batch."""
    import pyarrow as pa

    texts = ["The quick  Fox\x0b a\nb\tC\rd\x0ce", " lead and trail \n", None, "", "É Ünï\x1cx\x85y\x00", "\n\n", "a b c  a"] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for part in (batch, batch.slice(1, 900), batch.slice(1001), batch.slice(2, 2), batch.slice(0, 0)):
        wanted = [x.split() for x in lmscore.lowered(part, "text")]
        words, n = lmscore.split_words(part, "text")
        assert words.cast(pa.binary()).to_pylist() == [w for ws in wanted for w in ws] and n.tolist() == [len(ws) for ws in wanted]


def test_word_counts_do_not_depend_on_parts(odd, rows, monkeypatch):
    wanted = Counter(w for r in rows for w in (r[1] or "").translate(LOWER).encode().split())
    for held in (lmscore.HELD_WORDS, 5):
        monkeypatch.setattr(lmscore, "HELD_WORDS", held)
        assert {bytes(r["word"]): r["c"] for r in lmscore.word_counts(odd, "text").collect()} == wanted
