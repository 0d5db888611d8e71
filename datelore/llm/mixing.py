"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelore.llm.common import without

#: A mean above this is drawn as a sum of equal parts, which keeps the table of one draw short.
LARGEST_MEAN = 32.0


def bucket_of(source: Column, weights: dict[str, float]) -> Column:
    """The place of a source in ``weights``; all other sources and null share the next place."""
    places = F.create_map(*[F.lit(x) for pair in zip(weights, range(len(weights))) for x in pair])
    return F.coalesce(F.try_element_at(places, source), F.lit(len(weights)))


def source_rates(df: DataFrame, source: str, weights: dict[str, float], other: float, epochs: float) -> DataFrame:
    """Per bucket of sources: the mean repetition rate and the distribution function of one draw.

    At most one row for each entry of ``weights`` and one for the rest. The rate is the bucket's
    share of ``epochs`` times the number of documents, over the documents it has; the shares of
    buckets without documents fall to the others.
    """
    shares = F.element_at(F.array(*[F.lit(float(w)) for w in [*weights.values(), other]]), F.col("bucket") + 1)
    counts = df.groupBy(bucket_of(F.col(f"`{source}`"), weights).alias("bucket")).agg(F.count(F.lit(1)).alias("docs"))
    everything = Window.partitionBy()
    rates = counts.withColumn("weight", shares).select(
        "bucket",
        (F.lit(float(epochs)) * F.sum("docs").over(everything) * F.col("weight") / F.sum("weight").over(everything) / F.col("docs")).alias("rate"),
    )
    drawn = rates.fillna(0.0, ["rate"]).withColumn("draws", F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)))
    return drawn.select(
        "bucket", "rate", "draws",
        F.expr(
            """aggregate(
                 sequence(1, cast(ceil(rate / draws + 12 * sqrt(rate / draws) + 30) as int)),
                 named_struct('c', array(exp(-(rate / draws))), 'p', exp(-(rate / draws))),
                 (s, k) -> named_struct('c', array_append(s.c, element_at(s.c, -1) + s.p * (rate / draws) / k), 'p', s.p * (rate / draws) / k)
               ).c"""
        ).alias("cdf"),
    )


def mix_sources(
    df: DataFrame,
    weights: dict[str, float],
    other: float = 0.0,
    epochs: float = 1.0,
    seed: int = 0,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Repeat or leave out documents so that sources come in the proportions of ``weights``, in random order.

    A document comes as often as a Poisson variable with its source's mean rate, found by
    inverting the distribution function at a number hashed from ``seed`` and its id (its text
    where the id is null), so that a rerun gives the same rows. Sources missing in ``weights``
    and null form one group of weight ``other``. Rows with equal ids are repeated alike; empty and
    null texts are documents like others; an empty table gives an empty table. Adds ``rate``,
    ``n_copies``, ``copy`` (from 1) and ``order_key``, by which the rows are dealt to partitions
    and sorted in them; columns of the input with these names are replaced.

    The table of rates has one row for each entry of ``weights`` and one more, which bounds the
    broadcast; documents move once, by a key of their own, so that no source is a hot key.
    """
    rows = without(df, ["rate", "n_copies", "copy", "order_key"])
    names = rows.columns
    name = F.coalesce(F.col(f"`{id}`").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    keyed = rows.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), name.alias("name"), bucket_of(F.col(f"`{source}`"), weights).alias("bucket"))
    rated = keyed.join(F.broadcast(source_rates(rows, source, weights, other, epochs)), "bucket")

    def uniform(draw: Column) -> Column:
        digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), F.col("name"))), 1, 13)
        return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))

    chances = F.transform(F.sequence(F.lit(1).cast("long"), F.col("draws")), uniform)
    copies = F.aggregate(chances, F.lit(0).cast("long"), lambda total, u: total + F.size(F.filter(F.col("cdf"), lambda c: c < u)))
    counted = rated.select("row", "name", "rate", copies.alias("n_copies")).filter(F.col("n_copies") > 0)
    spread = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    ordered = spread.withColumn("order_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.col("name"), F.col("copy").cast("string"))))
    dealt = ordered.drop("name").repartition("order_key").sortWithinPartitions("order_key")
    return dealt.select(*[F.col("row")[n].alias(n) for n in names], "rate", "n_copies", "copy", "order_key")
