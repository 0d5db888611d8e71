"""SimHash near-duplicates by the general pigeonhole principle."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datelore.llm.common import LOWER_BYTES, extend, row_keys, saved, texts_of
from datelore.llm.components import attach, components

BITS = 64
SEED = 42
#: Fingerprints of a bucket that are compared together; larger buckets are split into blocks.
BLOCK = 4096
#: Cost of comparing two fingerprints against that of one row in the index.
PAIR_COST = 0.01


def text_bits(text: str, width: int) -> int:
    """SimHash of a text's shingles of ``width`` words, repeats included; 0 without words."""
    import xxhash

    words = text.encode().translate(LOWER_BYTES).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return majority_bits(np.array([digest(s, SEED) for s in shingles], "<u8"))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``df`` with ``bits``, the SimHash of each whole text as a signed long; null counts as empty, which gives 0."""

    def compute(batch):
        return [pa.array(np.array([text_bits(x, width) for x in texts_of(batch, text)], np.uint64).view(np.int64))]

    return extend(df, text, "bits long", compute)


def joint_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both: 64 x 64 sums over all of them."""

    def count(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            ones = np.unpackbits(batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (ones.T @ ones).astype(np.int64)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "n"])

    rows = distinct.select("bits").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    joint = np.zeros((BITS, BITS))
    for row in rows:
        joint[row["i"], row["j"]] = row["n"]
    return distinct.count(), joint


def grouped_bits(joint: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about equal size, strongly correlated ones together."""
    share = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs(joint / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        room = len(free) // (parts - k)
        group = [max(sorted(free), key=lambda b: tie[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < room:
            group.append(max(sorted(free), key=lambda b: tie[b, group].sum()))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def thresholds(groups: list[list[int]], share: np.ndarray, n: int, distance: int) -> tuple[float, list[int]]:
    """The cheapest threshold for each group, -1 for a group left out, by dynamic programming.

    Two fingerprints within ``distance`` are within the threshold on some group if the thresholds plus
    one sum up to ``distance + 1``. A threshold t costs a row for each set of t bits left open, and the
    pairs expected within t on the group, from the shares of ones of its bits.
    """
    costs, n = [], max(n, 2)
    for group in groups:
        within = np.array([1.0])
        for b in group:
            differ = 2 * share[b] * (1 - share[b])
            within = np.convolve(within, [1 - differ, differ])
        costs.append([0.0] + [n * math.comb(len(group), t) + PAIR_COST * n * n / 2 * within[: t + 1].sum() for t in range(min(distance, len(group)) + 1)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for each in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, more in enumerate(each):
                if used + t <= distance + 1 and cost + more < nxt.get(used + t, (math.inf, []))[0]:
                    nxt[used + t] = (cost + more, [*chosen, t - 1])
        best = nxt
    return best[distance + 1]


def probes(joint: np.ndarray, n: int, distance: int) -> list[int]:
    """Masks of the bits that a bucket fixes: close fingerprints agree under one of them at least."""
    share = np.diag(joint) / max(n, 1)
    options = []
    for parts in range(1, distance + 2):
        groups = grouped_bits(joint, n, parts)
        options.append((*thresholds(groups, share, n, distance), groups))
    _, chosen, groups = min(options, key=lambda x: x[0])
    masks = []
    for group, t in zip(groups, chosen):
        if t >= 0:
            masks += [sum(1 << b for b in group if b not in left) for left in combinations(group, t)]
    return masks


def close_links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Links ``(a, b)`` between fingerprints of ``distinct(bits)`` that connect whatever is within ``distance``.

    Every two close fingerprints share a bucket, and within a bucket (or two blocks of a large one) links
    form a forest that joins whatever close ones join, or are all there are where they are few.
    """
    n, joint = joint_counts(distinct)
    masks = probes(joint, n, distance)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    at = [F.struct(F.lit(k).alias("k"), F.col("bits").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(signed)]
    keys = distinct.select("bits", F.explode(F.array(*at)).alias("at")).select("bits", "at.k", "at.v")
    sizes = keys.groupBy("k", "v").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sized = attach(keys, sizes, ["k", "v"], F.col("bits"))
    blocks = F.ceil(F.col("size") / BLOCK)
    own = sized.select("k", "v", "bits", blocks.alias("blocks"), F.pmod(F.xxhash64("bits"), blocks).alias("own"))
    # A row of a bucket with several blocks meets each of them.
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = met.select("k", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "bits")
    dealt = pairs.repartition("k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j", "bits")

    def links(batches):
        held = np.zeros((0, 5), np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)])
            new = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            # The last bucket may go on in the next batch; it holds two blocks at most.
            end = int(new[-1]) if len(new) else 0
            held = rows[end:]
            yield _near(_unsigned(rows[:end]), np.append(0, new[:-1])[: len(new)], distance)
        yield _near(_unsigned(held), np.zeros(min(len(held), 1), np.int64), distance)

    def table(batches):
        for a, b in links(batches):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(table, "a long, b long")


def _unsigned(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, 4]).view(np.uint64)


def _near(bits: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of several buckets that begin at ``starts``: small ones side by side, others one by one."""
    sizes = np.diff(np.append(starts, len(bits)))
    left, right = [], []
    small = 16
    group = np.repeat(np.arange(len(starts)), sizes)
    little = np.repeat(sizes <= small, sizes)
    for lag in range(1, small):
        at = np.flatnonzero((group[lag:] == group[:-lag]) & little[lag:]) if len(bits) > lag else np.zeros(0, np.int64)
        if not len(at):
            break
        at = at[np.bitwise_count(bits[at] ^ bits[at + lag]) <= distance]
        left.append(bits[at])
        right.append(bits[at + lag])
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        a, b = _forest(np.unique(bits[s : s + n]), distance)
        left.append(a)
        right.append(b)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([*left, empty]), np.concatenate([*right, empty])


def _forest(bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the close ones of a bucket: each found fingerprint leaves the rest at once."""
    left, right = [], []
    rest = bits
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            one, front = front[0], front[1:]
            close = np.bitwise_count(rest ^ one) <= distance
            if close.any():
                found = rest[close]
                rest = rest[~close]
                left.append(np.full(len(found), one))
                right.append(found)
                front = np.concatenate([front, found])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([*left, empty]), np.concatenate([*right, empty])


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """For each row: its id, ``k1`` and ``k2`` (hashes of id and text), ``bits``, ``fingerprint`` (hex) and ``component_id``.

    Fingerprints at ``distance`` or fewer differing bits are linked; ``component_id`` is the
    smallest id reachable over links, null only where every row of the component has a null id. Null
    and empty texts and texts without words have fingerprint zero, linked like others. Rows with
    equal ids or texts all come back; other columns play no part; an empty table gives no rows.

    Copies meet as one fingerprint with its smallest id before anything is compared.
    """
    first, second = row_keys(F.col(f"`{id}`"), F.col(f"`{text}`"))
    rows = df.select(F.col(f"`{id}`").alias("id"), first.alias("k1"), second.alias("k2"), F.col(f"`{text}`").alias("text"))
    marked = saved(fingerprints(rows, "text", width).drop("text"), "fingerprints")
    leader = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2"))
    distinct = saved(marked.groupBy("bits").agg(leader.alias("leader")), "fingerprints")
    roots = components(close_links(distinct, distance))
    labelled = distinct.join(roots, F.col("bits") == F.col("node"), "left").select("bits", "leader", F.coalesce("root", "bits").alias("root"))
    heads = labelled.groupBy("root").agg(F.min("leader").alias("head"))
    headed = attach(labelled.select("root", "bits"), heads, ["root"], F.col("bits")).select("bits", "head")
    whole = attach(marked, headed, ["bits"], F.col("k1"))
    return whole.select(
        F.col("id").alias(id), "k1", "k2", "bits",
        F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        F.col("head.id").alias("component_id"),
        (F.struct("k1", "k2") == F.struct("head.k1", "head.k2")).alias("is_head"),
    )


def drop_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``df`` less near-duplicates: of each component one row with the smallest id stays.

    Among rows with that id the one with the smallest hash stays; null ids come last. All columns stay as they are.
    """
    heads = near_duplicates(df, id, text, width, distance).filter("is_head").select("k1", "k2").distinct()
    first, second = row_keys(F.col(f"`{id}`"), F.col(f"`{text}`"))
    packed = df.select(first.alias("k1"), second.alias("k2"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    kept = packed.join(heads, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select(*[F.col("row")[c].alias(c) for c in df.columns])
