"""Token counts: the exact histogram of encoded lengths and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datelore.llm.common import extend, saved, texts_of
from datelore.llm.words import word_encoder

#: Lengths in a span of this many are summed up together before the spans are.
SPAN = 1024


def token_counts(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``: the number of token ids of each whole text, 0 for null and empty texts."""

    def compute(batch):
        encoder = word_encoder(vocabulary)
        return [pa.array([len(encoder.encode(x)) // encoder.dtype.itemsize for x in texts_of(batch, text)], pa.int64())]

    return extend(df, text, "n_tokens long", compute)


def length_histogram(counted: DataFrame, by: Sequence[str] = (), length: str = "n_tokens") -> DataFrame:
    """Number of documents ``n_docs`` of each length, for each group of ``by``; counted in each task first."""
    return counted.groupBy(*by, F.col(length).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each length of the histogram, taken as a context limit:

    ``docs_at_least`` and ``tokens_at_least``: documents of that length or more and their tokens;
    ``truncated_tokens``: tokens left when every document is cut at the limit;
    ``total_docs``, ``total_tokens``; ``quantile``: share of documents not longer.

    Lengths are summed within spans and spans among themselves, so that a task holds one
    span, or one row for each span. Null groups are groups like others; an empty histogram gives
    no rows.
    """
    by = list(by)
    spans = saved(histogram, "lengths").withColumn("span", F.floor(F.col("n_tokens") / SPAN))
    tokens = F.col("n_tokens") * F.col("n_docs")
    totals = spans.groupBy(*by, "span").agg(F.sum("n_docs").alias("span_docs"), F.sum(tokens).alias("span_tokens"))
    later = Window.partitionBy(*by).orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    above = totals.select(
        *[F.col(c).alias(f"above_{c}") for c in by],
        F.col("span").alias("above_span"),
        F.coalesce(F.sum("span_docs").over(later), F.lit(0)).alias("above_docs"),
        F.coalesce(F.sum("span_tokens").over(later), F.lit(0)).alias("above_tokens"),
        F.sum("span_docs").over(group).alias("total_docs"),
        F.sum("span_tokens").over(group).alias("total_tokens"),
    )
    same = F.col("span") == F.col("above_span")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"above_{c}"))
    longer = Window.partitionBy(*by, "span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = spans.join(above, same).select(
        *by, "n_tokens", "n_docs", "total_docs", "total_tokens",
        (F.col("above_docs") + F.sum("n_docs").over(longer)).alias("docs_at_least"),
        (F.col("above_tokens") + F.sum(tokens).over(longer)).alias("tokens_at_least"),
    )
    return summed.select(
        *by, "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        "total_docs", "total_tokens",
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def truncated_totals(sums: DataFrame, limits: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Per group and context limit: ``kept_tokens`` when documents are cut there, and ``cut_docs``, those longer."""
    reached = [
        F.struct(
            F.lit(int(n)).cast("long").alias("limit"),
            F.min(F.when(F.col("n_tokens") >= n, F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias("first"),
            F.min(F.when(F.col("n_tokens") > n, F.struct("n_tokens", "docs_at_least"))).alias("next"),
        )
        for n in limits
    ]
    rows = sums.groupBy(*by).agg(F.max("total_tokens").alias("total_tokens"), F.array(*reached).alias("each"))
    at = rows.select(*by, "total_tokens", F.explode("each").alias("at"))
    under = F.col("total_tokens") - F.col("at.first.tokens_at_least") + F.col("at.limit") * F.col("at.first.docs_at_least")
    return at.select(
        *by,
        F.col("at.limit").alias("limit"),
        F.coalesce(under, F.col("total_tokens")).alias("kept_tokens"),
        F.coalesce(F.col("at.next.docs_at_least"), F.lit(0)).alias("cut_docs"),
    )


def length_quantiles(sums: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Per group and share: the smallest length that at least this share of the documents does not exceed."""
    each = [F.struct(F.lit(float(p)).alias("share"), F.min(F.when(F.col("quantile") >= p, F.col("n_tokens"))).alias("length")) for p in shares]
    return sums.groupBy(*by).agg(F.array(*each).alias("each")).select(*by, F.explode("each").alias("at")).select(*by, "at.share", "at.length")
