"""From documents to a training corpus: the stages in order, each a function of the table the one before left.

Each stage works on all rows it is given. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.llm.common import extend, fold, saved, texts_of
from datelore.llm.language import fit_language_model, has_letter, identify_language
from datelore.llm.lines import drop_common_lines
from datelore.llm.mixing import mix_sources
from datelore.llm.mixing_query import SEED, WEIGHTS
from datelore.llm.pieces import encode_and_decode
from datelore.llm.similar import drop_similar

#: A document stays if the calibrated chance of its language is at least this far from the chance level to certainty.
LEAST_CHANCE = 0.3


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _set_aside(docs: DataFrame, taken: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named like those an operator adds under other names, and the names."""
    names = {c: _unused(docs, f"{c}_own") for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(names), names


def _put_back(found: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``docs`` as they were."""
    return found.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters or of no clear language go.

    The model learns from the labelled documents that op2 learns from. ``lang`` stays as it is. With one
    language or none to learn there is no chance to judge by, and every text with a letter stays.
    """
    model = fit_language_model(docs, fold("doc_id", 4) != 2)
    if len(model.classes) < 2:
        letter = _unused(docs, "letter")
        known = extend(docs, "text", f"`{letter}` boolean", lambda batch: [pa.array([has_letter(x) for x in texts_of(batch, "text")], pa.bool_())])
        return known.filter(F.col(letter)).select(*docs.columns)
    level = 1 / len(model.classes)
    least = level + LEAST_CHANCE * (1 - level)
    lang, score = _unused(docs, "lang_told"), _unused(docs, "lang_chance")
    told = identify_language(docs, model, lang=lang, score=score)
    return told.filter((F.col(lang) != "und") & (F.col(score) >= least)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that ten or more of them share; ``n_chars`` follows the text.

    A document that loses all its lines stays, with an empty text.
    """
    own, names = _set_aside(docs, ["n_lines", "n_dropped"])
    kept = drop_common_lines(own, min_docs=10, min_chars=1, by_id=True)
    length = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return _put_back(kept.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)), docs, names)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Documents are near if they have at least 0.8 of all their shingles of five words in common; SimHash gives the
    first candidates and a forest of min-hash orders the rest, each held against the whole texts. Null and empty
    texts and texts without words are alike, so one of them stays; rows that repeat in id and text are
    one document; null ids come last; columns keep their values; an empty table stays empty.
    """
    return drop_similar(docs, width=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come in their target proportions, in random order.

    Null and unknown sources form one group of weight 1; null and empty texts are documents like others; rows that
    repeat are repeated alike; columns of the input keep their values; an empty table stays empty.
    """
    own, names = _set_aside(docs, ["rate", "n_copies", "copy", "order_key"])
    return _put_back(mix_sources(own, WEIGHTS, other=1.0, epochs=1.0, seed=SEED), docs, names)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its piece ids, their spans in the text, and whether decoding gives the text back.

    Null and empty texts have no pieces; rows that repeat have equal lists; columns of the input named ``ids``, ``begins``,
    ``ends``, ``decoded`` or ``round_trip`` are replaced; an empty table stays empty.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    return encode_and_decode(docs, model).withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit(""))).drop("decoded")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL has no language model and no tokenizer; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
