"""What the language stage of the pipeline rejects."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_documents_stay_where_no_language_can_be_learnt(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").limit(20)
    odd = docs.limit(1).withColumn("doc_id", F.lit(-1).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.lit("123 !?"))
    wanted = sorted(r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or ""))
    for lang in (F.lit(None).cast("string"), F.lit("en")):
        found = corpus_pipeline.language_stage(spark, docs.union(odd).withColumn("lang", lang), "")
        assert found.columns == docs.columns and sorted(r["doc_id"] for r in found.collect()) == wanted


def test_letters_of_no_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")  # the smallest samples teach too little to tell
    rng = random.Random(1)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (100, 500, 2000) for _ in range(30)]
    rows = [(-1 - i, x, None, "junk", len(x)) for i, x in enumerate(junk)]
    more = spark.createDataFrame(rows, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    found = corpus_pipeline.language_stage(spark, docs.select(*more.columns).union(more), "")
    kept = [r["doc_id"] for r in found.collect()]
    assert sum(i < 0 for i in kept) <= 2
    assert sum(i >= 0 for i in kept) >= 0.98 * docs.filter("lang is not null").count()
