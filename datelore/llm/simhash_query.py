"""Query of SimHash near-duplicates."""

from __future__ import annotations

from datelore.llm.registry import query
from datelore.llm.simhash import near_duplicates


@query("op9_simhash")
def simhash(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return near_duplicates(documents, width=3, distance=3).select("doc_id", "fingerprint", "component_id")
