"""Lines are counted by document id in the query and the pipeline."""

from pyspark.sql import functions as F

import corpus_pipeline
from datelore.llm.lines_query import line_dedup


def test_repeated_rows_of_one_id_count_once(spark, tmp_path):
    own = [(1, "only here\nshared")] * 12 + [(100 + i, f"own {i}\nshared") for i in range(9)] + [(None, "no id")] * 12
    docs = spark.createDataFrame(own, "doc_id long, text string").withColumn("n_chars", F.char_length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = line_dedup(spark, str(tmp_path)).groupBy("doc_id").agg(F.max("n_lines").alias("n"), F.max("n_dropped").alias("d"), F.count(F.lit(1)).alias("rows"))
    got = {r["doc_id"]: (r["n"], r["d"], r["rows"]) for r in found.collect()}
    assert got == {1: (2, 1, 12), None: (1, 0, 12)} | {100 + i: (2, 1, 1) for i in range(9)}
    kept = corpus_pipeline.line_stage(spark, docs, "").filter("doc_id = 1").select("text", "n_chars").distinct().collect()
    assert [tuple(r) for r in kept] == [("only here", 9)]
