"""Line deduplication: lines that many documents share are taken out of all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.llm.common import WHITE, ascii_lower, row_keys, without

#: The places of one common line are dealt to this many groups.
SALTS = 8


def line_key(line: Column) -> Column:
    """A line stripped of blanks at both ends, A-Z in lower case."""
    return ascii_lower(F.trim(line, F.lit(WHITE)))


def drop_common_lines(df: DataFrame, text: str = "text", id: str = "doc_id", min_docs: int = 10, min_chars: int = 1, by_id: bool = False) -> DataFrame:
    """Drop the lines whose key at least ``min_docs`` documents hold; adds ``n_lines`` and ``n_dropped``.

    Every row is a document of its own, rows with the same id too, and counts once for a key
    however often it holds it; with ``by_id`` rows of one id are one document, and rows without an
    id count for no key, as in ``count(DISTINCT id)``. Keys of fewer than ``min_chars`` code points are never dropped.
    A null text counts as one empty line and stays null; a text that loses all lines becomes
    empty. Columns of the input named like the two counts are replaced; an empty table gives an
    empty table.

    Keys travel as two 64-bit hashes. A row's keys are made distinct before they are counted, and
    counts are summed before the shuffle, so a line found everywhere is one row for each task; with
    ``by_id`` keys are dealt by key and id first, and then counted so. The positions of lines meet the common keys, of which every salt has a copy, in a join salted by
    row, so that the places of one line are spread over many tasks; texts move once, by row.
    """
    rows = without(df, ["n_lines", "n_dropped"])
    names = rows.columns
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    first, second = row_keys(F.col(f"`{id}`"), body)
    lines = F.split(body, "\n", -1)

    distinct = rows.select(F.col(f"`{id}`").alias("id"), F.explode(F.array_distinct(F.transform(lines, line_key))).alias("key"))
    keys = distinct.filter(F.char_length("key") >= min_chars).select("id", *[c.alias(n) for c, n in zip(row_keys(F.col("key")), ("k1", "k2"))])
    if by_id:
        keys = keys.filter(F.col("id").isNotNull()).distinct()
    common = keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)
    salted = common.select("k1", "k2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))

    exploded = rows.select(first.alias("r1"), second.alias("r2"), F.posexplode(lines).alias("pos", "line"))
    keyed = exploded.select("r1", "r2", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    placed = keyed.select("r1", "r2", "pos", F.pmod("r1", F.lit(SALTS)).alias("salt"), *[c.alias(n) for c, n in zip(row_keys(F.col("key")), ("k1", "k2"))])
    dropped = placed.join(salted, ["k1", "k2", "salt"], "left_semi").groupBy("r1", "r2").agg(F.collect_set("pos").alias("dropped"))

    packed = rows.select(first.alias("r1"), second.alias("r2"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    joined = packed.join(dropped, ["r1", "r2"], "left")
    split = joined.select("row", "dropped", F.split(F.coalesce(F.col("row")[text], F.lit("")), "\n", -1).alias("lines"))
    last = F.size("lines") - 1
    kept = F.transform(F.array_except(F.sequence(F.lit(0), last), F.col("dropped")), lambda i: F.get(F.col("lines"), i))
    whole = F.when(F.col("dropped").isNull(), F.col("row")[text]).otherwise(F.array_join(kept, "\n"))
    return split.select(
        *[(whole if n == text else F.col("row")[n]).alias(n) for n in names],
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
