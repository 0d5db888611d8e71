"""Query of line deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from datelore.llm.lines import drop_common_lines
from datelore.llm.registry import query

SQL = r"""
WITH lines AS (
    SELECT doc_id, i, l AS line,
           translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(p) AS l, generate_subscripts(p, 1) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))
),
common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, c.key IS NOT NULL AS dropped FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op10_line_dedup", SQL)
def line_dedup(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    kept = drop_common_lines(documents, min_docs=10, min_chars=1, by_id=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
