"""Query of nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from datelore.llm.registry import query
from datelore.llm.rotated import nearest


@query("op6_nearest_vectors")
def nearest_vectors(spark, folder):
    return nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)
