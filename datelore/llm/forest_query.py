"""Query of near-duplicates by a forest of min-hash orders."""

from __future__ import annotations

from datelore.llm.forest import near_copies
from datelore.llm.registry import query


@query("op13_minhash_forest")
def minhash_forest(spark, folder):
    return near_copies(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), width=3, similarity=0.85)
