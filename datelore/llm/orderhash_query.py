"""Query of Order MinHash fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from datelore.llm.orderhash import fingerprint_with_edit
from datelore.llm.registry import query


@query("op8_order_minhash")
def order_minhash(spark, folder):
    found = fingerprint_with_edit(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        F.lower(F.hex("print")).alias("fingerprint"), F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
