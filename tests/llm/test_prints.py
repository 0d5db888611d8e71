"""Order MinHash, SimHash and components against plain versions."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from datelore.llm import orderhash, simhash
from datelore.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unsigned(x):
    return x & (1 << 64) - 1


def plain_signature(text, s):
    def mix(x):
        x = unsigned((x ^ x >> 30) * 0xBF58476D1CE4E5B9)
        x = unsigned((x ^ x >> 27) * 0x94D049BB133111EB)
        return x ^ x >> 31

    if not text:
        return [0] * s.size
    k, seen, grams = min(s.k, len(text)), {}, []
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = unsigned(h * 0x100000001B3 + ord(c))
        h = mix(h)
        number = seen.get(h, 0)
        seen[h] = number + 1
        grams.append((h, mix(unsigned(h + number * 0x9E3779B97F4A7C15)) >> 32))
    out = []
    for turn, spread in zip(*(a.tolist() for a in s.orders())):
        first = sorted(range(len(grams)), key=lambda i: (((grams[i][1] ^ turn) * spread) & 0xFFFFFFFF, i))[: s.length]
        value = 0
        for i in sorted(first):
            value = mix(unsigned(unsigned(value * 31) + grams[i][0]))
        out.append(value >> 32)
    return out


def test_signatures_select_and_order():
    s = orderhash.Sketch(size=8)
    for text in ("", "a", "abc", "the cat sat on the mat and the cat sat", "aaaaaaaaaaaaaaa", "日本語🙂 " * 9):
        assert orderhash.signature(text, s, s.orders()).tolist() == plain_signature(text, s)


def test_signatures_follow_order_and_edits():
    rng, s = random.Random(2), orderhash.Sketch(size=256)
    words = [f"{rng.randrange(10**6)} " for _ in range(300)]
    text, turned = "".join(words), "".join(words[150:] + words[:150])
    edited = "".join(w if rng.random() > 0.05 else "x " for w in words)
    a, b, c = (orderhash.signature(t, s, s.orders()) for t in (text, turned, edited))
    assert orderhash.likeness(a, c) > orderhash.likeness(a, b) + 0.05 > 0.4
    assert orderhash.likeness(a, a) == 1


def test_edits_take_the_next_document(odd, rows, nothing, spark):
    s = orderhash.Sketch()
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    wanted = []
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        changed = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        own, new, other = (orderhash.signature(x, s, s.orders()) for x in (t, changed, following))
        wanted.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), own.astype(">u4").tobytes(), orderhash.likeness(own, new), orderhash.likeness(own, other)))
    found = [(r["doc_id"], r["n_chars"], r["edited_sha256"], bytes(r["print"]), r["near_edited"], r["near_next"]) for r in orderhash.fingerprint_with_edit(odd).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(found, key=key) == sorted(wanted, key=key)
    assert orderhash.fingerprint_with_edit(nothing).count() == 0
    alone = orderhash.fingerprint_with_edit(spark.createDataFrame([(5, "only one")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1 and alone["n_chars"] == 8


def plain_bits(text, width=3):
    words = [w for w in (text or "").translate(LOWER).encode().split()]
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates_of_odd_rows(odd, rows, nothing):
    bits = [plain_bits(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 3]
    group = plain_components(pairs, range(len(rows)))
    first = {}
    for k, r in enumerate(rows):
        first.setdefault(group[k], []).append(r[0])
    wanted = [(r[0] is None, r[0] or 0, format(bits[k], "016x"), min((i for i in first[group[k]] if i is not None), default=None)) for k, r in enumerate(rows)]
    found = simhash.near_duplicates(odd).collect()
    order = lambda r: (*r[:3], r[3] is None, r[3] or 0)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in found), key=order) == sorted(wanted, key=order)
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(first)
    assert simhash.near_duplicates(nothing).count() == 0 and len(simhash.probes(np.zeros((64, 64)), 0, 3)) == 4


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def planted(seed=4):
    """Random fingerprints, families within a few bits of each other and chains of them."""
    rng = random.Random(seed)
    found = {rng.getrandbits(64) for _ in range(400)}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(12):
            found.add(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    centre = rng.getrandbits(64)
    for _ in range(300):
        found.add(centre ^ sum(1 << b for b in rng.sample(range(20), 2)))
    return sorted(found)


def test_links_connect_all_that_is_close(spark, monkeypatch):
    values = planted()
    pairs = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3]
    wanted = plain_components([(signed(a), signed(b)) for a, b in pairs], [signed(v) for v in values])
    frame = spark.createDataFrame([(signed(v),) for v in values], "bits long")
    for block in (4096, 24):
        monkeypatch.setattr(simhash, "BLOCK", block)
        links = [tuple(r) for r in simhash.close_links(frame).collect()]
        assert all((unsigned(a) ^ unsigned(b)).bit_count() <= 3 for a, b in links)
        assert plain_components(links, [signed(v) for v in values]) == wanted


def test_probes_meet_every_close_pair():
    rng = random.Random(5)
    for n, skew in ((1000, 0.5), (10**9, 0.5), (10**12, 0.1)):
        share = np.where(np.arange(64) % 3 == 0, skew, 0.5)
        joint = np.outer(share, share) * n
        np.fill_diagonal(joint, share * n)
        masks = simhash.probes(joint, n, 3)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
            assert any(flips & m == 0 for m in masks)
    assert len(simhash.probes(np.full((64, 64), 0.25) * 100, 100, 3)) == 4


def test_thresholds_shift_to_balanced_bits():
    share = np.full(64, 0.5)
    share[:32] = 0.001
    groups = [list(range(32)), list(range(32, 64))]
    _, chosen = simhash.thresholds(groups, share, 10**9, 3)
    assert sum(t + 1 for t in chosen) == 4 and chosen[1] > chosen[0]


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    pairs += [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(250)]
    rng.shuffle(pairs)
    frame = spark.createDataFrame(pairs + pairs[:50], "a long, b long")
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    found = {r["node"]: r["root"] for r in components(frame).collect()}
    assert found == plain_components([p for p in pairs if p[0] != p[1]], nodes)
    assert components(frame.limit(0)).count() == 0
