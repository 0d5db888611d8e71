import random

import pytest
from pyspark.sql import types as T

TEXTS = [
    "The quick brown fox\njumps over the lazy dog\nCopyright 2020 Example",
    "the QUICK brown fox\n  copyright 2020 example\t\nend of it",
    "the QUICK brown fox\n  copyright 2020 example\t\nend of it",
    None,
    "",
    "\n\n",
    "word",
    " leading and  double  blanks ",
    "Größe über alles, naïve café — 日本語 🙂 ▁ <|endoftext|> <s>",
    "12345 !!! ???",
    " ".join(f"w{i % 977}x{i}" for i in range(20_000)),
    "a" * 30_000,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and columns named like results."""
    rng = random.Random(3)
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(rng.choice(["the", "cat", "sat", "on", "mats", "and"]) for _ in range(12)) + "\nCOPYRIGHT 2020 example", "en", "src0") for i in range(12)]
    rows += [rows[-1], rows[-1], (None, "no id here", "en", "src1"), (None, None, None, None)]
    clash = [("ids", T.StringType()), ("score", T.LongType()), ("n_tokens", T.StringType()), ("bits", T.StringType()), ("copy", T.StringType()), ("row", T.StringType()), ("N_Lines", T.StringType())]
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
        + [T.StructField(n, k) for n, k in clash]
    )
    filler = [("x", 1, "y", None, "z", "r", "n"), (None,) * len(clash)]
    return spark.createDataFrame([(*r, *filler[i % 2]) for i, r in enumerate(rows)], schema).repartition(3)


@pytest.fixture(scope="session")
def rows(odd):
    return [tuple(r)[:4] for r in odd.collect()]


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
