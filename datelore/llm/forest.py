"""Near-duplicates by a forest of sorted min-hash signatures; links are held against whole sets of shingles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.llm.common import LOWER_BYTES, extend, row_keys, saved, texts_of
from datelore.llm.components import attach, components

SEED = 42
#: Bits of each min-hash in a label, so that a label of seven is a positive long.
BITS = 9
#: Shingles that meet all hash functions together.
AT_ONCE = 1024
#: A region with more members than this is refined.
ROOM = 64
#: Shingles of the members of a region that a task compares together.
HELD = 1 << 18


@dataclass(frozen=True)
class Forest:
    """``trees`` sorted orders of texts by labels of ``deep`` min-hashes each; regions share at least ``shallow`` of them.

    Two texts with similarity s share no region with a chance of (1 - s ** deep) ** trees at most, of
    (1 - s ** shallow) ** trees where regions are small.
    """

    trees: int = 36
    shallow: int = 5
    deep: int = 7

    def miss(self, similarity: float) -> float:
        return (1 - similarity**self.deep) ** self.trees

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        made = np.random.default_rng(SEED)
        size = self.trees * self.deep
        return made.integers(0, 1 << 31, size, np.uint32) * np.uint32(2) + np.uint32(1), made.integers(0, 1 << 32, size, np.uint32)

    def labels(self, shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The label of a set in each tree; none without shingles."""
        if not len(shingles):
            return np.zeros(0, np.int64)
        factors, offsets = (f[:, None] for f in functions)
        x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
        for a in range(0, len(x), AT_ONCE):
            np.minimum(least, (factors * x[None, a : a + AT_ONCE] + offsets).min(axis=1), out=least)
        short = ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64).reshape(self.trees, self.deep)
        return (short << (BITS * np.arange(self.deep - 1, -1, -1))).sum(axis=1)

    def prefix(self, label: Column, depth: int) -> Column:
        return F.shiftright(label, BITS * (self.deep - depth))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many min-hashes two labels have in common from the front."""
        differ = a ^ b
        return sum((differ >> (BITS * (self.deep - d)) == 0).astype(np.int32) for d in range(1, self.deep + 1))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """The hashes of a text's shingles of ``width`` words, repeats included; a shorter text is one shingle, none without words."""
    import xxhash

    words = text.encode().translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], "<u8")


def text_shingles(text: str, width: int) -> np.ndarray:
    """The different hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, width))


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def set_marks(df: DataFrame, width: int, forest: Forest, also: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """``df`` less its text, with ``s1`` and ``s2`` (a hash of the set of shingles), ``n_shingles`` and ``labels``.

    With ``also`` there is ``bits`` too, what it makes of the hashes of all shingles (0 without any).
    """

    def compute(batch):
        import xxhash

        functions = forest.functions()
        sets, bits = [], []
        for x in texts_of(batch, "text"):
            every = shingle_hashes(x, width)
            sets.append(np.unique(every))
            bits.append(also(every) if also is not None and len(every) else 0)
        hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets), "<i8").reshape(-1, 2)
        labels = [forest.labels(s, functions).view(np.uint64) for s in sets]
        told = [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array([len(s) for s in sets], pa.int64()), lists_of(labels)]
        return told if also is None else [*told, pa.array(np.array(bits, np.uint64).view(np.int64))]

    outputs = "s1 long, s2 long, n_shingles long, labels array<long>" + (", bits long" if also is not None else "")
    return extend(df, "text", outputs, compute).drop("text")


def neighbours(nodes: DataFrame, forest: Forest) -> DataFrame:
    """``(tree, label, node, before, before_lcp, after, after_lcp)``: nodes with their neighbours in each sorted order.

    Rows are dealt by ranges of tree, label and node, so equal labels are no hot key. Only rows that share
    ``shallow`` min-hashes with a neighbour are kept, and the first and last of a range, whose neighbour is not seen.
    """
    flat = nodes.select("node", F.posexplode("labels").alias("tree", "label")).select("tree", "label", "node")
    sorted_ = flat.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    kinds = [("tree", pa.int32()), ("label", pa.int64()), ("node", pa.int64()), ("before", pa.int64()), ("before_lcp", pa.int32()), ("after", pa.int64()), ("after_lcp", pa.int32())]

    def scan(batches):
        held = None  # the last two rows, of which the later waits for its neighbour

        def table(rows, a, b, first, last):
            tree, label, node = rows
            common = np.where(tree[1:] == tree[:-1], forest.common(label[1:], label[:-1]), 0)
            before, after = np.append(0, common), np.append(common, 0)
            edge = np.zeros(len(tree), bool)
            edge[0], edge[-1] = first, last
            keep = np.flatnonzero((before >= forest.shallow) | (after >= forest.shallow) | edge)
            keep = keep[(keep >= a) & (keep < b)]
            left, right = node[np.maximum(keep - 1, 0)], node[np.minimum(keep + 1, len(node) - 1)]
            near, far = before[keep] >= forest.shallow, after[keep] >= forest.shallow
            columns = [tree[keep], label[keep], node[keep], left, before[keep], right, after[keep]]
            masks = [None, None, None, ~near, None, ~far, None]
            return pa.RecordBatch.from_arrays([pa.array(c, k, mask=m) for c, (_, k), m in zip(columns, kinds, masks)], names=[n for n, _ in kinds])

        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if not len(rows[0]):
                continue
            first = held is None or len(held[0]) == 1
            rows = rows if held is None else [np.append(a, b) for a, b in zip(held, rows)]
            yield table(rows, 0 if first else 1, len(rows[0]) - 1, first, False)
            held = [c[-2:] for c in rows]
        if held is not None:
            size = len(held[0])
            yield table(held, size - 1, size, size == 1, True)

    return sorted_.mapInArrow(scan, "tree int, label long, node long, before long, before_lcp int, after long, after_lcp int")


def group_links(sets: list[np.ndarray], parts: np.ndarray, front: np.ndarray, stay: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(x, y)`` that join what is similar among the sets: each set of ``front`` is held against all that are not joined to it.

    Sets of one part are joined from the start. Sets joined to part ``stay`` need not be held against others: those are in
    front themselves. A set meets all others at once, by the places of its shingles in all sets.
    """
    left, right, label = [], [], parts.copy()
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], True))
        if common and label[0] != label[1] and 1000 * common >= share * (sizes.sum() - common):
            return np.array([0]), np.array([1])
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, kind, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(kind, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    start, at = np.cumsum(count) - count, np.cumsum(sizes) - sizes
    for x in np.flatnonzero(front).tolist():
        if label[x] == stay:
            continue
        other = label != label[x]
        if not other.any():
            continue
        mine = kind[at[x] : at[x] + sizes[x]]
        many = count[mine]
        places = np.repeat(start[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
        common = np.bincount(owner[places], minlength=len(sets))
        hit = np.flatnonzero(other & (common > 0) & (1000 * common >= share * (sizes + sizes[x] - common)))
        if len(hit):
            found, first = np.unique(label[hit], return_index=True)
            left.append(np.full(len(found), x))
            right.append(hit[first])
            # What is joined takes the name of the part that stays, if that is among it.
            name = stay if stay in found else label[x]
            label[np.isin(label, found) | (label == label[x])] = name
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def confirmed(groups: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links ``(a, b)`` within ``groups(g, i, j, node, part, front, stay)``, held against ``sets(node, shingles)``.

    A group leaves at most one link for each member, whatever its size: what is joined is not linked again.
    """
    columns = ["g", "i", "j", "node", "part", "front", "stay", "shingles"]
    dealt = groups.join(sets, "node").select(columns).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")

    def work(table: pa.Table, starts: np.ndarray):
        nodes, parts, stays = (table.column(c).to_numpy() for c in ("node", "part", "stay"))
        front = np.array(table.column("front").to_pylist(), bool)
        lists = table.column("shingles").combine_chunks()
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        a, b = [], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(nodes)]):
            if e - s > 1 and not (parts[s:e] == parts[s]).all():
                x, y = group_links([values[ends[k] : ends[k + 1]] for k in range(s, e)], parts[s:e], front[s:e], stays[s], share)
                a.append(nodes[s + x])
                b.append(nodes[s + y])
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], names=["a", "b"])

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if not table.num_rows:
                continue
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("g", "i", "j")])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            end = int(new[-1]) if len(new) else 0
            if end:
                yield work(table.slice(0, end), np.append(0, new[:-1]))
            held = table.slice(end)
        if held is not None and held.num_rows:
            yield work(held, np.zeros(1, np.int64))

    return dealt.mapInArrow(compare, "a long, b long")


def shingle_sets(nodes: DataFrame, texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(node, shingles)`` of the nodes in ``wanted(node)``, from the text of each node's leader."""
    at = nodes.join(wanted.distinct(), "node", "left_semi").select("node", F.col("leader.k1").alias("k1"), F.col("leader.k2").alias("k2"))
    own = texts.join(at, ["k1", "k2"]).dropDuplicates(["node"]).select("node", "text")
    made = extend(own, "text", "shingles array<long>", lambda batch: [lists_of([text_shingles(x, width) for x in texts_of(batch, "text")])]).drop("text")
    return saved(made, "shingles")


def pair_groups(pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` as groups for ``confirmed``: each ``a`` in front of its ``b``."""
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    fronts = pairs.select("a").distinct().select("a", F.col("a").alias("node"), F.lit(True).alias("front"))
    rows = fronts.union(pairs.select("a", F.col("b").alias("node"), F.lit(False).alias("front")))
    return rows.select(F.col("a").alias("g"), zero.alias("i"), zero.alias("j"), "node", F.col("node").alias("part"), "front", none.alias("stay"))


def open_regions(near: DataFrame, parts: DataFrame, forest: Forest) -> DataFrame:
    """``(g, node, part, n_shingles)``: members of regions that hold several parts.

    A region is what shares the first ``shallow`` min-hashes in one tree; one with more than ``ROOM`` members is cut
    by the next min-hash, down to ``deep``. Sizes are counted before rows meet them in a salted join.
    """
    level = near.select("tree", "label", "node").join(parts, "node")
    found = []
    for depth in range(forest.shallow, forest.deep + 1):
        level = level.withColumn("g", F.xxhash64(F.lit(depth), "tree", forest.prefix(F.col("label"), depth)))
        sizes = level.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("part").alias("least"), F.max("part").alias("most"))
        met = attach(level, sizes.filter("least < most").select("g", "size"), ["g"], F.col("node"))
        met = saved(met, "regions")
        last = depth == forest.deep
        found.append((met if last else met.filter(F.col("size") <= ROOM)).select("g", "node", "part", "n_shingles"))
        if last or met.filter(F.col("size") > ROOM).isEmpty():
            break
        level = met.filter(F.col("size") > ROOM).select("tree", "label", "node", "part", "n_shingles")
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    return rows


def region_groups(rows: DataFrame) -> DataFrame:
    """Members of regions as groups for ``confirmed``, cut to about ``HELD`` shingles.

    The largest part of a region stays where it is; members of the others are in front. A large region is cut into blocks
    of members and blocks of fronts, and each of the one meets each of the other.
    """
    parts = rows.groupBy("g", "part").agg(F.sum("n_shingles").alias("held"))
    stats = parts.groupBy("g").agg(F.max(F.struct("held", "part")).alias("top"), F.sum("held").alias("all"))
    blocks, fronts = F.ceil(F.col("all") / HELD), F.ceil((F.col("all") - F.col("top.held")) / HELD)
    cut = stats.select("g", F.col("top.part").alias("stay"), blocks.alias("blocks"), F.greatest(fronts, F.lit(1)).alias("fronts"))
    met = attach(rows, cut, ["g"], F.col("node"))
    ahead, zero = F.col("part") != F.col("stay"), F.lit(0).cast("long")
    member, own = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("fronts"))

    def every(name: str) -> Column:
        return F.explode(F.sequence(zero, F.col(name) - 1))

    single = met.filter("blocks = 1").select("g", zero.alias("i"), zero.alias("j"), "node", "part", ahead.alias("front"), "stay")
    large = met.filter("blocks > 1")
    members = large.select("g", member.alias("i"), every("fronts").alias("j"), "node", "part", F.lit(False).alias("front"), "stay")
    heads = large.filter(ahead).select("g", every("blocks").alias("i"), own.alias("j"), "node", "part", F.lit(True).alias("front"), "stay")
    return single.union(members).union(heads)


def similar_links(nodes: DataFrame, texts: DataFrame, width: int, similarity: float, forest: Forest, first: DataFrame | None = None) -> DataFrame:
    """Links ``(a, b)`` that connect whatever of ``nodes(node, leader, n_shingles, labels)`` shares a region and is similar.

    Each node meets its neighbours with the longest common prefix, and the pairs ``first(a, b)``;
    the regions that are not one component then are compared as wholes. Every link is confirmed on whole sets.
    """
    share = round(1000 * similarity)
    near = saved(neighbours(nodes, forest), "neighbours")
    best = near.groupBy("node").agg(F.max(F.struct("before_lcp", "before")).alias("x"), F.max(F.struct("after_lcp", "after")).alias("y"))
    both = best.select("node", F.explode(F.array("x.before", "y.after")).alias("other")).filter("other is not null")
    pairs = both.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    pairs = saved((pairs if first is None else pairs.union(first)).distinct(), "pairs")
    sets = shingle_sets(nodes, texts, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), width)
    links = saved(confirmed(pair_groups(pairs), sets, share), "links")
    parts = nodes.select("node", "n_shingles").join(components(links), "node", "left").select("node", "n_shingles", F.coalesce("root", "node").alias("part"))
    rows = saved(open_regions(near, parts, forest), "regions")
    sets = shingle_sets(nodes, texts, rows.select("node"), width)
    return links.union(saved(confirmed(region_groups(rows), sets, share), "links"))


def near_copies(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, similarity: float = 0.85, forest: Forest = Forest()) -> DataFrame:
    """For each row: its id, ``n_shingles``, ``component_id`` and ``kept``.

    Texts are linked if their sets of shingles of ``width`` words (A-Z as a-z, a shorter text is one shingle) have at
    least ``similarity`` of all their shingles in common, in thousandths. ``component_id`` is the smallest id reachable,
    null only where every row of a component has a null id; ``kept`` tells whether it is the row's own id
    (false for null ids). Null texts, empty ones and texts without words have no shingles and are linked with
    nothing, each its own component. Rows with equal ids or texts all come back; other columns
    play no part; an empty table gives no rows.

    Texts with the same set meet as one node before anything is compared.
    """
    first, second = row_keys(F.col(f"`{id}`"), F.col(f"`{text}`"))
    rows = df.select(F.col(f"`{id}`").alias("id"), first.alias("k1"), second.alias("k2"), F.col(f"`{text}`").alias("text"))
    marked = saved(set_marks(rows, width, forest), "marks")
    leader = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("leader")
    distinct = marked.filter("n_shingles > 0").groupBy("s1", "s2").agg(leader, F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels"))
    # Numbers of rows are only relied on after they are written down.
    nodes = saved(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = components(similar_links(nodes, rows.select("k1", "k2", "text"), width, similarity, forest))
    labelled = nodes.join(roots, "node", "left").select("s1", "s2", "leader", F.coalesce("root", "node").alias("root"))
    heads = labelled.groupBy("root").agg(F.min("leader").alias("head"))
    headed = attach(labelled.select("s1", "s2", "root"), heads, ["root"], F.col("s1")).select("s1", "s2", F.col("head.id").alias("head"))
    known = attach(marked.filter("n_shingles > 0").select("id", "k1", "n_shingles", "s1", "s2"), headed, ["s1", "s2"], F.col("k1")).select("id", "n_shingles", "head")
    whole = known.union(marked.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("head")))
    return whole.select(F.col("id").alias(id), "n_shingles", F.col("head").alias("component_id"), F.coalesce(F.col("id") == F.col("head"), F.lit(False)).alias("kept"))
