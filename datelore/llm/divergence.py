"""How the sources of each language differ in their use of words, over run-length columns of counts."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelore.llm.common import saved, slices, texts_of

#: Bytes of terms as bytes.translate maps them: letters as lower case, other ASCII as blanks, the rest as it is.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UNIT = 1_000_000_000
#: Different terms a task holds before it hands them on.
HELD = 1_000_000
#: Rows of counts that are compared together.
BLOCK = 2048
#: Bytes of a table of counts in a task.
TABLE_BYTES = 32 << 20


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term and documents that hold it; a row without term for each group.

    Counts are summed in tasks, up to ``HELD`` terms at a time, before they are shuffled.
    """

    def count(batches):
        sums: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def out():
            for (a, b), (n, docs) in sums.items():
                terms = list(n)
                for at in range(0, len(terms), 50_000):
                    some = terms[at : at + 50_000]
                    size = len(some)
                    columns = [[a] * size, [b] * size, [t.decode() for t in some], [n[t] for t in some], [docs[t] for t in some]]
                    yield table(columns)
                yield table([[a], [b], [None], [0], [0]])
            sums.clear()

        def table(columns):
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for part in slices(batch, "text"):
                for x, a, b in zip(texts_of(part, "text"), texts_of(part, "lang"), texts_of(part, "source")):
                    n, docs = sums[a, b]
                    terms = x.encode().translate(TERM_BYTES).split()
                    n.update(terms)
                    docs.update(set(terms))
                if sum(len(n) for n, _ in sums.values()) > HELD:
                    yield from out()
        yield from out()

    texts = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))
    counted = texts.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """p = 1 + floor(1000000000 * (n + 2) / (total + 2 * terms)), exact for any counts."""
    wide = "decimal(38,0)"
    return F.lit(1).cast("long") + F.call_function("div", F.lit(UNIT).cast(wide) * (n + 2).cast(wide), (total + 2 * terms).cast(wide))


def shares(n: np.ndarray, divisor: int) -> np.ndarray:
    """The same for an array of counts; in exact integers of any size where 64 bits are too few."""
    if not len(n) or int(n.max()) + 2 < (1 << 63) // UNIT:
        return 1 + UNIT * (n + 2) // divisor
    return np.array([1 + UNIT * (int(x) + 2) // divisor for x in n], np.int64)


def run_lengths(column: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers of a column start."""
    new = np.ones(len(column), bool)
    new[1:] = column[1:] != column[:-1]
    return np.flatnonzero(new)


def pair_sums(counts: np.ndarray, times: np.ndarray, divisors: list[int]) -> np.ndarray:
    """For each two columns of ``counts`` the sum of f over its rows, each of which stands ``times`` times.

    Rows are put in order so that equal counts stand side by side; each column is cut into runs, once
    with their p. Two columns are compared once for each run of both, times the run's length.
    """
    order = np.lexsort(counts.T[::-1])
    counts, upto = counts[order], np.append(0, np.cumsum(times[order]))
    starts = [run_lengths(column) for column in counts.T]
    p = [shares(column[s], d) for column, s, d in zip(counts.T, starts, divisors)]
    size = len(divisors)
    out = np.zeros((size, size), np.int64)
    for i in range(size):
        for j in range(i + 1, size):
            cuts = np.union1d(starts[i], starts[j])
            a = p[i][np.searchsorted(starts[i], cuts, "right") - 1]
            b = p[j][np.searchsorted(starts[j], cuts, "right") - 1]
            length = np.diff(upto[np.append(cuts, len(counts))])
            out[i, j] = out[j, i] = int(((a - b) ** 2 // (a + b) * length).sum())
    return out


def source_pairs(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every two sources of a language.

    ``vectors(lang, counts, times)`` has each different row of counts with the number of terms that have it, so
    terms that all sources use alike are one row before anything is compared. Rows are dealt to blocks, each with
    a copy of its language's groups; blocks give partial sums, which Spark adds.
    """
    sizes = vectors.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    head = groups.select("lang", "source", (F.col("total") + 2 * F.col("terms")).alias("divisor")).join(sizes, "lang")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    nothing = F.lit(None).cast("array<struct<source:string,n:bigint>>")
    heads = head.select("lang", every.alias("block"), "source", "divisor", nothing.alias("counts"), F.lit(None).cast("long").alias("times"))
    rows = vectors.join(sizes, "lang").select(
        "lang", F.pmod(F.xxhash64("counts"), F.col("blocks")).alias("block"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("divisor"), "counts", "times"
    )
    dealt = heads.unionByName(rows).repartition("lang", "block").sortWithinPartitions("lang", "block", F.col("source").isNull(), "source")

    def add(batches):
        key, names, divisors, table, times, sums = None, [], [], [], [], None

        def work():
            nonlocal sums, table, times
            if table:
                where = {s: i for i, s in enumerate(names)}
                counts = np.zeros((len(table), len(names)), np.int64)
                for r, row in enumerate(table):
                    for x in row:
                        counts[r, where[x["source"]]] = x["n"]
                part = pair_sums(counts, np.array(times, np.int64), divisors)
                sums = part if sums is None else sums + part
            table, times = [], []

        def out():
            work()
            if sums is not None:
                lang, size = key[0], len(names)
                for i in range(size):
                    others = [j for j in range(size) if j != i]
                    if others:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(others)), pa.array([names[i]] * len(others)), pa.array([names[j] for j in others]), pa.array(sums[i, others])],
                            names=["lang", "source", "item", "value"],
                        )

        for batch in batches:
            for row in batch.to_pylist():
                if (row["lang"], row["block"]) != key:
                    yield from out()
                    key, names, divisors, sums = (row["lang"], row["block"]), [], [], None
                if row["source"] is not None:
                    names.append(row["source"])
                    divisors.append(row["divisor"])
                else:
                    table.append(row["counts"])
                    times.append(row["times"])
                    if len(table) * len(names) * 8 > TABLE_BYTES:
                        work()
        yield from out()

    return dealt.mapInArrow(add, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source of a language is from the others, and its own terms.

    Terms are runs of ASCII letters and characters outside ASCII, A-Z as a-z. A language keeps the
    terms that at least ``min_docs`` of its rows hold, V of them. A group (a source of a language, or the
    whole language) with N occurrences of kept terms gives a term with n of them
    p = 1 + floor(10^9 (n + 2) / (N + 2 V)); two shares differ by f = floor((p - q)^2 / (p + q)).

    Part ``pair`` has for each other source of the language the sum of f over kept terms (0 without any), all ranks.
    Part ``term`` has f of the terms that a source uses more than its language, ``top`` of them. Ranks
    start at 1 in each group and part, by falling value, then item in byte order.

    Null texts, languages and sources count as empty; every row is a document, repeated rows too; a
    source without terms still has its pairs; one source alone has none; an empty table gives no rows. Other
    columns play no part. All arithmetic is in whole numbers, exact up to sums of 2^63.
    """
    counts = saved(term_counts(df, text, lang, source), "terms")
    of_lang = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).filter(F.col("docs") >= min_docs)
    kept = saved(counts.filter("term is not null").join(of_lang.drop("docs"), ["lang", "term"]).select("lang", "source", "term", "n", "all"), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = kept.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("all_total"))
    groups = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = saved(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "all_total")]), "groups")

    vectors = kept.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
    vectors = saved(vectors.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("times")), "vectors")
    sums = source_pairs(vectors, groups)
    # A language without kept terms has no blocks; its pairs are all at 0.
    bare = groups.filter("terms = 0").select("lang", "source")
    at_zero = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").select("lang", "source", "item", zero.alias("value"))
    pairs = sums.select("lang", "source", "item", "value").unionByName(at_zero).withColumn("part", F.lit("pair"))

    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("all"), F.col("all_total"), F.col("terms"))
    shared = kept.filter("n > 0").join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    terms = shared.select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    best = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(order)).select(columns).unionByName(best.select(columns))
