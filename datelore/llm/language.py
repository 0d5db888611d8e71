"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelore.llm.common import extend, texts_of

LETTER = re.compile(r"[^\W\d_]")
#: Odd multipliers that spread n-grams of 1, 2 and 3 code points over the buckets.
SPREAD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
CHARS_AT_ONCE = 1 << 20


@dataclass
class Settings:
    """``buckets`` bounds the model; ``sample_per_class`` and ``sample_bytes`` (for all classes) bound the labelled rows it is fitted on.

    The model and what it is fitted with grow with the number of classes, of which there are ``classes`` at most.
    """

    buckets: int = 1 << 15
    sample_per_class: int = 1000
    sample_bytes: int = 128 << 20
    classes: int = 1000
    longest: int = 3
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-5
    seed: int = 7


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter; signs such as ² count as word characters but not as letters."""
    return any(found.group().isalpha() for found in LETTER.finditer(text))


def gram_counts(text: str, buckets: int, longest: int = 3) -> np.ndarray:
    """How often n-grams of 1 to ``longest`` characters of the lower-cased text fall into each bucket.

    Each run of white space counts as one blank and the text stands between two blanks.
    """
    shift = 32 - (buckets.bit_length() - 1)
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), "<u4")
    counts = np.zeros(buckets, np.int64)
    for a in range(0, len(points), CHARS_AT_ONCE):
        part = points[a : a + CHARS_AT_ONCE + longest - 1]
        hashed = np.zeros(len(part), np.uint32)
        for n in range(longest):
            if len(part) <= n:
                break
            hashed = (hashed[: len(part) - n] ^ part[n:]) * np.uint32(SPREAD[n % 3])
            hashed ^= hashed >> np.uint32(15)
            # Grams that begin in the overlap belong to the next part.
            counts += np.bincount((hashed[:CHARS_AT_ONCE] * np.uint32(SPREAD[0])) >> np.uint32(shift), minlength=buckets)
    return counts


@dataclass
class LanguageModel:
    """Weights by bucket and class, inverse document frequencies and the temperature."""

    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    settings: Settings = field(default_factory=Settings)

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _features(counts, self.idf)

    def logits(self, text: str) -> np.ndarray:
        index, values = self.features(gram_counts(text, self.settings.buckets, self.settings.longest))
        return values @ self.weights[index] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.classes or not text or not has_letter(text):
            return "und", 0.0
        chances = _softmax(self.logits(text) / self.temperature)
        best = int(chances.argmax())
        return self.classes[best], float(chances[best])


def _features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets met and their weights: (1 + log count) times idf, of length one."""
    index = np.flatnonzero(counts)
    values = (1 + np.log(counts[index])) * idf[index]
    return index, values / max(np.sqrt(values @ values), 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights by follow-the-regularised-leader with per-coordinate rates and elastic-net penalties.

    The last coordinate is the bias, which has no penalty.
    """
    z = np.zeros((s.buckets + 1, classes))
    g2 = np.zeros((s.buckets + 1, classes))

    def leader(index: np.ndarray) -> np.ndarray:
        zi = z[index]
        l1 = np.where(index == s.buckets, 0.0, s.l1)[:, None]
        return -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((s.beta + np.sqrt(g2[index])) / s.alpha + s.l2)

    order = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for k in order.permutation(len(rows)):
            index, values = np.append(rows[k][0], s.buckets), np.append(rows[k][1], 1.0)
            w = leader(index)
            error = _softmax(values @ w)
            error[labels[k]] -= 1
            g = values[:, None] * error
            old = g2[index]
            new = old + g * g
            z[index] += g - (np.sqrt(new) - np.sqrt(old)) / s.alpha * w
            g2[index] = new
    w = leader(np.arange(s.buckets + 1))
    return w[:-1], w[-1]


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on rows the weights have not seen, by golden section on its logarithm.

    A label counts as 1 - 1 / (rows + 2) of the truth, which keeps separable classes from certainty.
    """
    n, classes = logits.shape
    if not n or classes < 2:
        return 1.0
    doubt = 1 / (n + 2)
    truth = np.full(logits.shape, doubt / (classes - 1))
    truth[np.arange(n), labels] = 1 - doubt

    def loss(t: float) -> float:
        scaled = logits / np.exp(t)
        top = scaled.max(axis=1, keepdims=True)
        return float((np.log(np.exp(scaled - top).sum(axis=1)) + top[:, 0] - (truth * scaled).sum(axis=1)).mean())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_language_model(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", id: str = "doc_id", settings: Settings | None = None) -> LanguageModel:
    """Learn from the rows where ``learn`` holds and ``lang`` is not null.

    Document frequencies cover all of them: tasks add up their own and Spark sums these by
    bucket. The weights are fitted on up to ``sample_per_class`` different rows of each class, those with the
    smallest hash of id and text, as far as their n-grams fit into the class's share of ``sample_bytes``; a
    fifth of them only sets the temperature. Rows that repeat in id, text and language count once in
    the sample. Texts without letters teach nothing. Without labelled rows the model has no classes and
    answers ``und``. More than ``classes`` languages are an error.
    """
    s = settings or Settings()
    rows = df.filter(learn & F.col(f"`{lang}`").isNotNull()).select(
        F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.lit(s.seed), F.col(f"`{id}`"), F.col(f"`{text}`")).alias("draw")
    )
    # A row brings eight bytes for each different n-gram.
    weight = F.coalesce(8 * F.least(F.char_length("text") * s.longest + s.longest, F.lit(s.buckets)), F.lit(0))
    once = rows.groupBy("lang", "draw").agg(F.max(weight).alias("weight"))
    known = {r["lang"]: r["n"] for r in once.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(s.classes + 1).collect()}
    classes = sorted(known)
    if len(classes) > s.classes:
        raise ValueError(f"more languages to learn than the {s.classes} that the setting allows")

    def frequencies(batches):
        found, docs = np.zeros(s.buckets, np.int64), 0
        for batch in batches:
            for x in texts_of(batch, "text"):
                found += gram_counts(x, s.buckets, s.longest) > 0
                docs += 1
        index = np.append(np.flatnonzero(found), s.buckets)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(np.append(found, docs)[index])], names=["bucket", "n"])

    found = np.zeros(s.buckets + 1)
    for r in rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r["bucket"]] = r["n"]
    idf = np.log((1 + found[-1]) / (1 + found[:-1])) + 1

    def sampled(batches):
        for batch in batches:
            out = []
            for x in texts_of(batch, "text"):
                counts = gram_counts(x, s.buckets, s.longest)
                index = np.flatnonzero(counts)
                out.append((index.astype("<i4").tobytes(), counts[index].astype("<i4").tobytes()) if has_letter(x) else (b"", b""))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["lang", "draw", "at", "n"])

    # Twice as many as wanted are drawn by a bound on the hash, and of these the smallest.
    share = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30)
    likely = F.lit(False)
    for c, n in known.items():
        likely = likely | ((F.col("lang") == c) & (share < min(1.0, 2 * s.sample_per_class / n)))
    by_draw = Window.partitionBy("lang").orderBy("draw")
    drawn = once.filter(likely).withColumn("rank", F.row_number().over(by_draw)).filter(F.col("rank") <= s.sample_per_class)
    fitting = drawn.withColumn("held", F.sum("weight").over(by_draw)).filter((F.col("held") <= s.sample_bytes / max(len(classes), 1)) | (F.col("rank") == 1))
    wanted = rows.filter(likely).dropDuplicates(["lang", "draw"]).join(fitting.select("lang", "draw"), ["lang", "draw"], "left_semi")
    sample = wanted.select("text", "lang", "draw").mapInArrow(sampled, "lang string, draw long, at binary, n binary").collect() if classes else []
    sample = sorted((r for r in sample if r["at"]), key=lambda r: (r["draw"], r["lang"]))
    data = []
    for r in sample:
        index, n = np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i4")
        values = (1 + np.log(n)) * idf[index]
        data.append((index.astype(np.int64), values / np.sqrt(values @ values)))
    labels = [classes.index(r["lang"]) for r in sample]
    unseen = [k for k in range(len(data)) if k % 5 == 0 and len(data) >= 20]
    seen = sorted(set(range(len(data))) - set(unseen))
    weights, bias = follow_the_leader([data[k] for k in seen], [labels[k] for k in seen], len(classes), s)
    logits = np.array([data[k][1] @ weights[data[k][0]] + bias for k in unseen]).reshape(len(unseen), len(classes))
    temperature = calibrated(logits, np.array([labels[k] for k in unseen], int))
    return LanguageModel(classes, idf, weights, bias, temperature, s)


def identify_language(df: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (or other names), the calibrated chance of the predicted language.

    Null texts and texts without a letter get ``und`` and 0. A text is looked at whole and by itself; columns
    of these names are replaced and others stay. The model's size is bounded by buckets times classes.
    """

    def compute(batch):
        found = [model.predict(x) for x in batch.column(text).to_pylist()]
        return [pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())]

    return extend(df, text, f"`{lang}` string, `{score}` double", compute)
