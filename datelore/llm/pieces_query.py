"""Query of SentencePiece encoding and decoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from datelore.llm.pieces import encode_and_decode
from datelore.llm.registry import query


@query("op4_sentencepiece")
def sentencepiece_round_trip(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = encode_and_decode(documents, model)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        # The last span ends where the text does.
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),
        # Where all pieces begin, then where all end, joined by commas.
        F.sha2(F.array_join(F.concat("begins", "ends"), ","), 256).alias("spans_sha256"),
    )
