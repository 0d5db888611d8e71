"""Query of language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from datelore.llm.common import fold
from datelore.llm.language import fit_language_model, identify_language
from datelore.llm.registry import query


@query("op2_language_id")
def language_id(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    held_out = fold("doc_id", 4) == 2
    model = fit_language_model(documents, ~held_out)
    rows = documents.select("doc_id", "text", held_out.alias("held_out"))
    return identify_language(rows, model).select("doc_id", "held_out", "lang_pred", "score")
