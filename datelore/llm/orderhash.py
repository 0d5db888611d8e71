"""Document fingerprints by Order MinHash, which follow the edit distance of texts."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datelore.llm.common import saved, texts_of

#: Hash values worked on together.
AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Sketch:
    """``size`` samples of ``length`` k-mers each, every one under an order of its own drawn from ``seed``."""

    k: int = 5
    length: int = 2
    size: int = 32
    seed: int = 11

    def orders(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed)
        return draw.integers(0, 1 << 32, self.size, np.uint64).astype(np.uint32), draw.integers(0, 1 << 31, self.size, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(text: str, sketch: Sketch, orders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One 32-bit number for each sample: the hash of its k-mers in the order of the text.

    k-mers count code points and are told apart by their occurrence number; a shorter text is one
    k-mer, the empty text gives zeros.
    """
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(points):
        return np.zeros(sketch.size, np.uint32)
    k = min(sketch.k, len(points))
    grams = np.zeros(len(points) - k + 1, np.uint64)
    for i in range(k):
        grams = grams * np.uint64(0x100000001B3) + points[i : len(points) - k + 1 + i]
    grams = _mixed(grams)
    # Occurrence numbers: the place of each k-mer among its equals.
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    number = np.empty(len(grams), np.uint64)
    number[order] = np.arange(len(grams)) - np.repeat(first, np.diff(np.append(first, len(grams))))
    base = (_mixed(grams + number * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    take = min(sketch.length, len(grams))
    out = np.empty(sketch.size, np.uint32)
    step = max(1, AT_ONCE // len(base))
    turn, spread = orders
    for a in range(0, sketch.size, step):
        hashed = (base ^ turn[a : a + step, None]) * spread[a : a + step, None]
        rows = np.arange(len(hashed))
        places = np.empty((len(hashed), take), np.int64)
        for t in range(take):
            places[:, t] = hashed.argmin(axis=1)
            hashed[rows, places[:, t]] = np.uint32(0xFFFFFFFF)
        places.sort(axis=1)
        value = np.zeros(len(hashed), np.uint64)
        for t in range(take):
            value = _mixed(value * np.uint64(31) + grams[places[:, t]])
        out[a : a + step] = (value >> np.uint64(32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of samples two fingerprints have in common."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by as many from the start of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


FIELDS = "n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double"


def fingerprint_with_edit(df: DataFrame, id: str = "doc_id", text: str = "text", sketch: Sketch | None = None) -> DataFrame:
    """Fingerprints of whole texts and of edited ones, with their likenesses.

    Adds to the id ``n_chars``, ``edited_sha256``, ``print`` and ``edited_print`` (32-bit numbers, big-endian),
    ``near_edited`` and ``near_next``, the likeness of the fingerprint to the edited text's and to the next
    document's. The next document is the one with the next larger id, after the last the first; rows with
    equal ids follow each other by text, null ids come first. Null texts are empty; two empty texts are alike.
    An empty table gives no rows.

    Rows are dealt by range of id and sorted; a task holds one document and the one before.
    Only the last document of each range waits for the first of the next one, which meet in a
    join of one row for each range.
    """
    sketch = sketch or Sketch()
    rows = df.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind_of_id = rows.schema["id"].dataType.simpleString()
    dealt = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")

    def finish(text: str, own: np.ndarray, following: str, other: np.ndarray, orders) -> tuple:
        changed = edited(text, following)
        new = own if changed == text else signature(changed, sketch, orders)
        return (
            len(text), hashlib.sha256(changed.encode()).hexdigest(), own.astype(">u4").tobytes(), new.astype(">u4").tobytes(), likeness(own, new), likeness(own, other),
        )

    def walk(batches):
        orders, part = sketch.orders(), TaskContext.get().partitionId()
        held = None
        for batch in batches:
            ids, out, ends = [], [], []
            for one, x in zip(batch.column(0), texts_of(batch, "text")):
                own = signature(x, sketch, orders)
                if held is None:
                    ends.append((one, "first", x, own))
                else:
                    ids.append(held[0])
                    out.append(finish(held[1], held[2], x, own, orders))
                held = one, x, own
            yield table(part, ids, out, ends)
        if held is not None:
            yield table(part, [], [], [(held[0], "last", held[1], held[2])])

    def table(part, ids, out, ends):
        n, m = len(ids), len(ends)
        columns = list(zip(*out)) if out else [()] * 6
        kinds = [f.type for f in arrow]
        values = [
            pa.array([i.as_py() for i in ids] + [e[0].as_py() for e in ends], kinds[0]),
            *[pa.array([*column, *([None] * m if k != 2 else [e[3].astype(">u4").tobytes() for e in ends])], kinds[k + 1]) for k, column in enumerate(columns)],
            pa.array([part] * (n + m), pa.int64()),
            pa.array([None] * n + [e[1] for e in ends], pa.string()),
            pa.array([None] * n + [e[2] for e in ends], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(values, names=[f.name for f in arrow])

    schema = f"id {kind_of_id}, {FIELDS}, part long, end string, text string"
    arrow = _arrow(rows, schema)
    walked = saved(dealt.mapInArrow(walk, schema), "fingerprints")

    firsts = walked.filter("end = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("print").alias("next_print"))
    parts = firsts.select(F.col("next_part").alias("part"))
    order = Window.orderBy("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next_part"))
    lasts = walked.filter("end = 'last'").join(following, "part").join(firsts, "next_part").select("id", "text", "print", "next_text", "next_print")

    def complete(batches):
        orders = sketch.orders()
        for batch in batches:
            out = [
                finish(x, np.frombuffer(a, ">u4").astype(np.uint32), y, np.frombuffer(b, ">u4").astype(np.uint32), orders)
                for x, a, y, b in zip(*[batch.column(c).to_pylist() for c in ("text", "print", "next_text", "next_print")])
            ]
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), f.type) for c, f in zip(columns, arrow[1:7])]], names=[f.name for f in arrow[:7]]
            )

    names = ["id", *[f.split()[0] for f in FIELDS.split(", ")]]
    done = walked.filter("end is null").select(*names)
    return done.union(lasts.mapInArrow(complete, f"id {kind_of_id}, {FIELDS}")).withColumnRenamed("id", id)


def _arrow(rows: DataFrame, schema: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return list(to_arrow_schema(_parse_datatype_string(schema)))
