"""Query of token counts."""

from __future__ import annotations

import public_tokenizers

from datelore.llm.lengths import length_histogram, suffix_sums, token_counts
from datelore.llm.registry import query


@query("op5_token_counts")
def token_lengths(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("text")
    counted = token_counts(documents, public_tokenizers.path("byte_bpe_50k.json"))
    return suffix_sums(length_histogram(counted))
