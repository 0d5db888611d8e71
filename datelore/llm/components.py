"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.llm.common import saved

#: Rows of one key are dealt to this many groups in a salted join.
SALTS = 8


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner") -> DataFrame:
    """Join ``rows`` with a table of one row for each key, of which every salt has a copy.

    ``spread`` tells rows of one key apart, so that a key with many rows is dealt to many tasks.
    """
    every = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    copies = table.withColumn("_salt", F.explode(every))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS))).join(copies, [*keys, "_salt"], how).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: the root is the smallest node of its component.

    Links and nodes are longs; loops and repeated links do no harm; no links give no rows. Each
    round hangs the larger neighbours of a node below its smallest one, then the smaller neighbours, until
    every component is a star; the number of rounds grows with the logarithm of the longest
    path. A round's links are written to the shared folder. Smallest neighbours are aggregates and meet
    the links in salted joins, so that the centre of a star is no hot key.
    """
    found = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        state = found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or not state[0]:
            break
        mark = tuple(state)
        found = saved(_small_star(_large_star(found)), "links")
    roots = found.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return found.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of its neighbours and itself."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = attach(both.filter("v > u"), least, ["u"], F.col("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    linked = attach(links, least, ["u"], F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
