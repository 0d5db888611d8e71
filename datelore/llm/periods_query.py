"""Query of periodic runs, a tenth of the texts made periodic from some word on."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from datelore.llm.common import extend, texts_of
from datelore.llm.periods import periodic_runs
from datelore.llm.registry import query


def made_periodic(text: str, id: str) -> str:
    """The words of a text joined by blanks; for a tenth of the ids the words from one on repeat with a period."""
    words, h = text.encode().split(), zlib.crc32(id.encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + i % p] for i in range(n - a)]
    return b" ".join(words).decode()


@query("op12_periodic_runs")
def periodic_runs_of_documents(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")

    def edit(batch):
        ids = ["" if i is None else str(i) for i in batch.column("doc_id").to_pylist()]
        return [pa.array([made_periodic(x, i) for x, i in zip(texts_of(batch, "text"), ids)], pa.string())]

    found = periodic_runs(extend(documents, "text", "edited string", edit).drop("text"), "edited", least=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"),
        F.expr("1000 * best.length div -best.less").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
