"""Line deduplication and mixing against plain versions."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from datelore.llm.lines import drop_common_lines
from datelore.llm.mixing import mix_sources

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(LOWER)


def plain_lines(texts, least):
    docs = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and docs[key(x)] >= least)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_common_lines_go_from_every_document(odd, rows):
    texts = [r[1] for r in rows]
    for least in (2, 10):
        found = drop_common_lines(odd, min_docs=least).select("n_lines", "n_dropped", F.coalesce("text", F.lit("")).alias("text"))
        assert sorted(map(tuple, found.collect())) == sorted(plain_lines(texts, least))


def test_lines_keep_other_columns_and_empty_tables(odd, nothing):
    found = drop_common_lines(odd)
    assert found.columns == [c for c in odd.columns if c != "N_Lines"] + ["n_lines", "n_dropped"]
    assert found.filter("row = 'r'").count() == odd.filter("row = 'r'").count()
    assert drop_common_lines(nothing).count() == 0


def test_a_line_in_every_document_is_found_across_salts(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("Same Line\nown "), F.col("id").cast("string")).alias("text")).repartition(7)
    found = drop_common_lines(docs)
    assert found.filter("n_dropped = 1 and n_lines = 2 and text = concat('own ', doc_id)").count() == 500


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while total < u and k < 1000:
        k += 1
        p = p * rate / k
        total += p
    return k


def test_mixing_meets_weights_and_repeats_itself(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 100 == 1, "b").otherwise("c").alias("source"))
    mixed = mix_sources(docs, {"a": 1.0, "b": 2.0, "unknown": 5.0}, other=1.0, epochs=1.0, seed=1)
    counts = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for source, share in {"a": 0.25, "b": 0.5, "c": 0.25}.items():
        # Rates above the largest mean are drawn in parts; their sums must still hold.
        assert abs(counts[source] - 30_000 * share) < 6 * math.sqrt(30_000 * share * (20 if source == "b" else 1))
    again = mix_sources(docs.repartition(5), {"a": 1.0, "b": 2.0, "unknown": 5.0}, other=1.0, epochs=1.0, seed=1)
    assert mixed.exceptAll(again).count() == 0 and again.exceptAll(mixed).count() == 0
    keys = [r["order_key"] for r in mixed.select("order_key", F.spark_partition_id().alias("p")).filter("p = 0").collect()]
    assert keys == sorted(keys)


def test_mixing_inverts_the_distribution(spark):
    import hashlib

    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("a").alias("source"))
    found = {r["doc_id"]: r["n_copies"] for r in mix_sources(docs, {"a": 1.0}, epochs=2.5, seed=9).collect()}
    for i in range(2_000):
        u = (int(hashlib.md5(f"9|1|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert found.get(i, 0) == poisson(u, 2.5)


def test_mixing_takes_odd_rows(odd, nothing):
    mixed = mix_sources(odd, {"src0": 1.0, "src1": 1.0}, other=1.0, epochs=40.0)
    assert mixed.select("doc_id", "text").distinct().count() == odd.select("doc_id", "text").distinct().count()
    assert mix_sources(odd, {"src0": 1.0}, other=0.0).filter("source <> 'src0' or source is null").count() == 0
    assert mix_sources(nothing, {"src0": 1.0}).count() == 0
