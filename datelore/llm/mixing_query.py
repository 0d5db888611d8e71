"""Query of source mixing."""

from __future__ import annotations

from datelore.llm.mixing import LARGEST_MEAN, mix_sources
from datelore.llm.registry import query

#: Twenty named sources in four steps of weight; what comes from elsewhere shares one more unit.
WEIGHTS = {f"src{i}": 1.0 + i % 4 for i in range(20)}
SEED = 17

SQL = f"""
WITH RECURSIVE wanted(source, weight) AS (VALUES {", ".join(f"('{s}', {w}::DOUBLE)" for s, w in WEIGHTS.items())}),
doc AS (
    SELECT d.*, w.source AS bucket, coalesce(w.weight, 1.0::DOUBLE) AS weight,
           coalesce(d.doc_id::VARCHAR, 'text ' || md5(coalesce(d.text, ''))) AS name
    FROM documents d LEFT JOIN wanted w ON d.source = w.source
),
bucket AS (SELECT bucket, any_value(weight) AS weight, count(*) AS docs FROM doc GROUP BY bucket),
rated AS (SELECT bucket, 1.0::DOUBLE * (SELECT sum(docs) FROM bucket) * weight / (SELECT sum(weight) FROM bucket) / docs AS rate FROM bucket),
drawn AS (SELECT *, greatest(ceil(rate / {LARGEST_MEAN}), 1)::BIGINT AS draws FROM rated),
cdf AS (
    SELECT bucket, 0 AS k, exp(-(rate / draws)) AS p, exp(-(rate / draws)) AS c, rate / draws AS r FROM drawn
    UNION ALL
    SELECT bucket, k + 1, p * r / (k + 1), c + p * r / (k + 1), r FROM cdf WHERE k + 1 <= ceil(r + 12 * sqrt(r) + 30)
),
chance AS (
    SELECT name, bucket, draw, any_value(rate) AS rate,
           ((('0x' || substr(md5('{SEED}|' || draw || '|' || name), 1, 13))::BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM (SELECT DISTINCT name, t.bucket, rate, unnest(range(1, draws + 1)) AS draw
          FROM doc t JOIN drawn d ON t.bucket IS NOT DISTINCT FROM d.bucket)
    GROUP BY name, bucket, draw
),
counted AS (
    SELECT name, rate, sum(hits)::BIGINT AS n_copies
    FROM (SELECT a.name, a.draw, any_value(a.rate) AS rate, count(c.k) AS hits
          FROM chance a LEFT JOIN cdf c ON a.bucket IS NOT DISTINCT FROM c.bucket AND c.c < a.u GROUP BY a.name, a.draw)
    GROUP BY name, rate
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, n.rate, n.n_copies, n.copy,
       md5('{SEED}|order|' || d.name || '|' || n.copy) AS order_key
FROM doc d JOIN (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM counted) n ON d.name = n.name
"""


@query("op1_mix_sources", SQL)
def mixed(spark, folder):
    return mix_sources(spark.read.parquet(f"{folder}/documents.parquet"), WEIGHTS, other=1.0, epochs=1.0, seed=SEED)
