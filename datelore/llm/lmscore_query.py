"""Query of language-model scores."""

from __future__ import annotations

from datelore.llm.common import fold
from datelore.llm.lmscore import fit, score_texts
from datelore.llm.registry import query


@query("op3_lm_score")
def lm_score(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    held_out = fold("doc_id", 5) == 1
    model = fit(documents, ~held_out)
    return score_texts(documents.select("doc_id", "text", held_out.alias("held_out")), model)
