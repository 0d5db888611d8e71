"""Query of token files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from datelore.llm.common import scratch
from datelore.llm.registry import query
from datelore.llm.shards import read_token_shards, write_token_shards

END_ID = 2


@query("op7_token_files")
def token_files(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    target = scratch(spark, "tokens")
    shards = write_token_shards(documents, target, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return read_token_shards(shards, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
