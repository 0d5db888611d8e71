"""The pipeline against plain versions of its stages, on the smallest sample."""

import hashlib
import math

import public_tokenizers
import pytest

import corpus_pipeline
from datelore.llm.common import fold
from datelore.llm.language import fit_language_model
from datelore.llm.mixing_query import SEED, WEIGHTS
from datelore.llm.pieces import PieceEncoder
from tests.llm.test_lines_mixing import plain_lines, poisson
from tests.llm.test_similar import plain_survivors


def plain_pipeline(docs, model):
    """(doc_id, text, source) rows after each stage."""
    level = 1 / len(model.classes)
    least = level + corpus_pipeline.LEAST_CHANCE * (1 - level)
    rows = [(i, t, s) for i, t, s in docs if (p := model.predict(t))[0] != "und" and p[1] >= least]
    rows = [(i, kept, s) for (i, _, s), (_, _, kept) in zip(rows, plain_lines([t for _, t, _ in rows], 10))]
    stay = set(plain_survivors({i: t for i, t, _ in rows}))
    rows = [r for r in rows if r[0] in stay]
    counts = {}
    for _, _, s in rows:
        counts[s if s in WEIGHTS else None] = counts.get(s if s in WEIGHTS else None, 0) + 1
    total = sum(WEIGHTS.get(s, 1.0) for s in counts)
    mixed = []
    for i, t, s in rows:
        s = s if s in WEIGHTS else None
        rate = len(rows) * WEIGHTS.get(s, 1.0) / total / counts[s]
        parts = max(1, math.ceil(rate / 32))
        for draw in range(1, parts + 1):
            u = (int(hashlib.md5(f"{SEED}|{draw}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            mixed += [(i, t)] * poisson(u, rate / parts)
    return mixed


def test_pipeline_equals_plain_stages(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    model = fit_language_model(docs, fold("doc_id", 4) != 2)
    library = PieceEncoder(public_tokenizers.path("piece_bpe_32k.model")).library
    wanted = sorted((i, t, library.encode(t)) for i, t in plain_pipeline([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], model))
    found = corpus_pipeline.run(spark, sample).collect()
    assert sorted((r["doc_id"], r["text"], r["ids"]) for r in found) == wanted
    assert all(r["round_trip"] and r["n_chars"] == len(r["text"]) and r["ends"][-1:] in ([], [len(r["text"].encode())]) for r in found)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, odd, nothing, sample, name, stage):
    from pyspark.sql import functions as F

    docs = odd.drop("ids", "score", "N_Lines").withColumn("n_chars", F.char_length("text").cast("long"))
    for rows in (docs, docs.limit(0)):
        found = stage(spark, rows, sample)
        assert found.columns[: len(docs.columns)] == docs.columns
        assert (name == "sentencepiece") == ("ids" in found.columns)
        assert found.count() <= (3 if name == "mixing" else 1) * max(rows.count(), 0) + (0 if name != "mixing" else 20)


def test_columns_of_the_caller_keep_their_values(spark, odd, sample):
    """Columns named like those that operators add come out as they went in."""
    from pyspark.sql import functions as F

    names = ["n_dropped", "N_LINES", "copy", "rate", "order_key", "N_copies", "lang_told", "bits", "labels", "node", "n_shingles"]
    docs = odd.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"), *[F.lit(f"my {n}").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sample)
        assert found.columns == docs.columns
        rows = found.select(*[F.col(f"`{n}`") for n in names]).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(f"my {n}" for n in names)], name
