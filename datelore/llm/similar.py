"""Near-duplicates for corpora: SimHash links first, then whatever else is similar; every link is held against whole sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datelore.llm.common import row_keys, saved
from datelore.llm.components import components
from datelore.llm.forest import Forest, set_marks, similar_links
from datelore.llm.simhash import close_links, majority_bits

#: Texts with similarity 0.8 share no region with a chance of 2e-6, less above.
FOREST = Forest(trees=44, shallow=5, deep=6)
#: SimHash links have at most so many differing bits.
DISTANCE = 3


def simhash_pairs(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``(a, b)`` of ``nodes(node, bits)`` that connect those within ``distance`` bits."""
    prints = saved(nodes.groupBy("bits").agg(F.min("node").alias("head")), "fingerprints")
    same = nodes.join(prints, "bits").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = saved(close_links(prints.select("bits"), distance), "links")
    ends = [prints.select(F.col("bits").alias(c), F.col("head").alias(f"node_{c}")) for c in "ab"]
    near = links.join(ends[0], "a").join(ends[1], "b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return same.union(near)


def drop_similar(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, forest: Forest = FOREST) -> DataFrame:
    """The rows of ``df`` less near-duplicates: of each component one row with the smallest id stays.

    Texts are linked if their sets of shingles of ``width`` words (A-Z as a-z; a shorter text is one
    shingle) have at least ``similarity`` of all their shingles in common, in thousandths. Links are
    found by SimHash first and for the rest by a forest of min-hash orders, and each is held against the
    sets themselves. Null and empty texts and texts without words are alike. Rows that repeat in
    id and text are one document. Among rows with the smallest id the one with the smallest hash stays; null ids
    come last. All columns stay as they are; an empty table gives an empty table.

    Texts with the same set meet as one before anything is compared.
    """
    first, second = row_keys(F.col(f"`{id}`"), F.col(f"`{text}`"))
    rows = df.select(F.col(f"`{id}`").alias("id"), first.alias("k1"), second.alias("k2"), F.col(f"`{text}`").alias("text"))
    marked = saved(set_marks(rows, width, forest, majority_bits), "marks")
    leader = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("leader")
    once = [F.first(c).alias(c) for c in ("n_shingles", "labels")]
    # Texts of one set can differ in how often they repeat a shingle, and so in bits; any of them will do.
    distinct = marked.groupBy("s1", "s2").agg(leader, F.min("bits").alias("bits"), *once)
    # Numbers of rows are only relied on after they are written down.
    nodes = saved(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    worded = nodes.filter("n_shingles > 0")
    links = similar_links(worded, rows.select("k1", "k2", "text"), width, similarity, forest, simhash_pairs(worded.select("node", "bits")))
    labelled = nodes.join(components(links), "node", "left").select("leader", F.coalesce("root", "node").alias("root"))
    heads = labelled.groupBy("root").agg(F.min("leader").alias("head")).select("head.k1", "head.k2")
    packed = df.select(first.alias("k1"), second.alias("k2"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    kept = packed.join(heads, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select(*[F.col("row")[c].alias(c) for c in df.columns])
