"""Scoring texts with a context-tree language model, beside a plain count of words.

The model is a table: the grams (a byte after ``depth`` others) of the corpus and their counts, dealt to buckets by
the last bytes of the context, so that a bucket holds whole branches of the tree. Its size follows the corpus. Texts
ask for the grams they hold, each once for a block of texts, and get their logarithms back from the bucket's branches.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelore.llm.common import LOWER_BYTES, extend, saved, slices, texts_of
from datelore.llm.contexttree import EDGE, ContextTree, Level, grams, runs, sums

#: Different grams a task holds before it hands them on.
HELD = 2_000_000
#: Different words likewise.
HELD_WORDS = 300_000
#: Bytes of text for each bucket of grams.
BUCKET_BYTES = 8 << 20
#: Bytes of the context that tell a branch, and so the levels above branches: contexts of 0 to 2 bytes.
CUT = 3
#: Bytes of a block of texts, which asks for each of its grams once; a longer text is a block of its own.
BLOCK_BYTES = 32 << 20
#: A context is a node of its own if it was seen at least so often.
LEAST = 2
#: Grams of the branches that are built into one tree; a larger branch is a tree of its own.
TREE_GRAMS = 1 << 16


@dataclass
class LanguageModel:
    """A context tree and the counts of words it was learnt beside.

    ``branches(bucket, grams, n)`` is the table of all grams, sorted, one row for each bucket; ``top`` the levels of contexts
    shorter than ``cut``. ``words`` is the whole table of training words with their counts, ``frequent`` those that
    make up at least one token in ``frequent`` of ``fit``, of which there are no more than that many.
    """

    depth: int
    buckets: int
    branches: DataFrame
    top: list[Level]
    words: DataFrame
    frequent: dict[bytes, int]
    tokens: int
    distinct: int
    documents: int

    def log_share(self, count: int) -> float:
        return math.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def lowered(batch: pa.RecordBatch, text: str) -> list[bytes]:
    return [x.encode().translate(LOWER_BYTES) for x in texts_of(batch, text)]


def split_words(batch: pa.RecordBatch, text: str) -> tuple[pa.Array, np.ndarray]:
    """The words of the lowered texts, one after another, and how many each text has; null is empty."""
    split = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(batch.column(text)), ""))
    words, row = pc.list_flatten(split), pc.list_parent_indices(split)
    some = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty one
    return words.filter(some), np.bincount(row.filter(some).to_numpy(zero_copy_only=False), minlength=batch.num_rows)


def trim() -> None:
    """Give back to the system what this process holds but does not use, as far as its C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(job: Callable) -> Callable:
    """A job on batches that leaves no memory of its own behind: its worker lives on beside others when the task is over."""

    @functools.wraps(job)
    def run(batches):
        yield from job(batches)
        trim()

    return run


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys, kind="stable")  # sorted runs, which it takes one after another
    keys, n = keys[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The different numbers of some arrays, sorted."""
    keys = np.sort(np.concatenate(parts))
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _compressed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _restored(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, so that the many equal ones compress."""
    rows = values.view(np.uint8).reshape(-1, values.itemsize)
    planes = np.empty(rows.shape[::-1], np.uint8)
    for i in range(len(planes)):
        planes[i] = rows[:, i]
    return _compressed(planes.tobytes())


def unpacked(x: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(_restored(x), np.uint8).reshape(size, -1)
    rows = np.empty(planes.shape[::-1], np.uint8)
    for i in range(size):
        rows[:, i] = planes[i]
    return rows.reshape(-1).view(dtype)


def packed_grams(keys: np.ndarray) -> bytes:
    """Sorted grams as the steps between them."""
    return packed(np.diff(keys, prepend=0))


def unpacked_grams(x: bytes) -> np.ndarray:
    return np.cumsum(unpacked(x, "<i8"))


class Places:
    """Where each of some numbers stands, in a table of their hashes: for many lookups in no order."""

    AT_ONCE = 1 << 18

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers
        self.bits = max(int(2.5 * len(numbers)).bit_length(), 4)
        self.table = np.full(1 << self.bits, -1, np.int32)
        for a in range(0, len(numbers), self.AT_ONCE):
            first, step = self._first(numbers[a : a + self.AT_ONCE]), 0
            left = np.arange(a, a + len(first), dtype=np.int32)
            while len(left):
                slot = (first[left - a] + step) & (len(self.table) - 1)
                free = self.table[slot] < 0
                self.table[slot[free]] = left[free]
                left, step = left[self.table[slot] != left], step + 1

    def _first(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """Places of numbers that are all there."""
        out = np.empty(len(numbers), np.int32)
        for a in range(0, len(numbers), self.AT_ONCE):
            some = numbers[a : a + self.AT_ONCE]
            first, step = self._first(some), 1
            found = self.table[first]
            left = np.flatnonzero(self.numbers[found] != some)
            while len(left):
                found[left] = self.table[(first[left] + step) & (len(self.table) - 1)]
                left, step = left[self.numbers[found[left]] != some[left]], step + 1
            out[a : a + self.AT_ONCE] = found
        return out


def cut_of(depth: int) -> int:
    return min(CUT, depth)


def endings(keys: np.ndarray, depth: int) -> np.ndarray:
    """The last bytes of the grams' contexts, which tell their branches."""
    return (keys >> 8) & ((1 << 8 * cut_of(depth)) - 1)


def alike(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each of some numbers, ascending, and where it stands, in order."""
    order = np.argsort(numbers, kind="stable")
    found = numbers[order]
    starts = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        yield int(numbers[order[a]]), order[a:b]


def by_bucket(keys: np.ndarray, depth: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Which of some sorted grams belong to each bucket, still in order. All contexts with the same last bytes share one."""
    hashed = endings(keys, depth).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (hashed >> np.uint64(33)).astype(np.int64) % buckets
    yield from alike(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket)  # short numbers are sorted quickest


def by_branches(keys: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """Which of some sorted grams go into each tree, still in order, and the first ending there. Endings ascend and are never divided."""
    ending = endings(keys, depth)
    order = np.argsort(ending, kind="stable")
    ending = ending[order]
    if not len(order):
        yield 0, order
    a = 0
    while a < len(order):
        b = min(a + TREE_GRAMS, len(order))
        if b < len(order):
            first, last = (int(np.searchsorted(ending, ending[b], side)) for side in ("left", "right"))
            b = first if first > a else last
        yield int(ending[a]), order[a:b]
        a = b


def gram_counts(df: DataFrame, text: str, depth: int, buckets: int) -> DataFrame:
    """``(bucket, grams, n)``: how often each gram stands in the texts, summed in tasks as far as they hold them.

    Grams come as sorted lists for each bucket, packed.
    """

    @trimmed
    def count(batches):
        parts, held = [], 0

        def out():
            keys, n = parts.pop()
            for bucket, at in by_bucket(keys, depth, buckets):
                columns = [pa.array([bucket], pa.int32()), pa.array([packed_grams(keys[at])], pa.binary()), pa.array([packed(n[at])], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "grams", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                parts.append(np.unique(grams(lowered(part, "text"), depth)[0], return_counts=True))
                held += len(parts[-1][0])
                if held > HELD:
                    parts = [_merged(parts)]
                    if len(parts[0][0]) > HELD // 2:
                        yield from out()
                    held = sum(len(k) for k, _ in parts)
        if parts:
            parts = [_merged(parts)]
            yield from out()

    return df.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "bucket int, grams binary, n binary")


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``(word, c)``: how often each word stands in the texts, summed in tasks as far as they hold them, then by Spark."""

    @trimmed
    def count(batches):
        parts, held = [], 0

        def table():
            return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                found = split_words(part, "text")[0].value_counts()
                parts.append(pa.table([found.field(0).cast(pa.binary()), found.field(1)], ["word", "n"]))
                held += len(found)
                if held > 2 * HELD_WORDS:
                    parts = [table()]
                    if len(parts[0]) > HELD_WORDS:
                        yield from parts.pop().to_batches()
                    held = sum(map(len, parts))
        if parts:
            yield from table().to_batches()

    counted = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


def merged_buckets(counts: DataFrame) -> DataFrame:
    """One row for each bucket of ``counts(bucket, grams, n)``, with all its grams and their sums."""

    @trimmed
    def merge(batches):
        key, parts = None, []

        def row():
            keys, n = _merged(parts)
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([packed_grams(keys)], pa.binary()), pa.array([packed(n)], pa.binary())], names=["bucket", "grams", "n"])

        for batch in batches:
            for bucket, steps, n in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != key and parts:
                    yield row()
                    parts = []
                key = bucket
                parts.append((unpacked_grams(steps), unpacked(n, "<i8")))
                if len(parts) > 1 and sum(len(k) for k, _ in parts[1:]) > max(HELD, len(parts[0][0])):
                    parts = [_merged(parts)]
        if parts:
            yield row()

    dealt = counts.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(merge, "bucket int, grams binary, n binary")


def branch(depth: int, keys: np.ndarray, n: np.ndarray, top: list[Level] | None = None) -> ContextTree:
    """The tree of the grams of a bucket below the levels ``top``: contexts seen at least ``LEAST`` times are nodes.

    Without ``top`` it can be weighed but not asked.
    """
    top = [None] * cut_of(depth) if top is None else top
    byte, rows = keys & 0xFF, []
    for d in range(cut_of(depth), depth + 1):
        pair, place = np.unique((((keys >> 8) & ((1 << 8 * d) - 1)) << 8) | byte, return_inverse=True)
        number = np.bincount(place, n, len(pair)) if len(pair) else np.zeros(0)
        context, at = runs(pair >> 8)
        often = (np.bincount(at, number, len(context)) >= LEAST)[at] if len(pair) else np.zeros(0, bool)
        rows.append((np.full(often.sum(), d), pair[often] >> 8, pair[often] & 0xFF, number[often]))
    return ContextTree(depth, *(np.concatenate(c) for c in zip(*rows)), top=top)


class Branches:
    """The trees of the grams of a bucket, each of some of its branches, so that no more than these are ever worked on at once."""

    def __init__(self, depth: int, keys: np.ndarray, n: np.ndarray, top: list[Level]):
        self.depth, firsts, self.trees = depth, [], []
        for first, at in by_branches(keys, depth):
            some = keys[at]
            firsts.append(first)
            self.trees.append(branch(depth, some, n[at], top))
            self.trees[-1].log10(some)  # and so remembered
        self.firsts = np.array(firsts)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys))
        tree = np.searchsorted(self.firsts, endings(keys, self.depth), "right") - 1
        for i, at in alike(np.maximum(tree, 0)):
            out[at] = self.trees[i].log10(keys[at])
        return out


def top_levels(branches: DataFrame, depth: int) -> list[Level]:
    """The levels above the branches, weighed.

    What they need of the branches is summed up by Spark for each context of ``CUT - 1`` bytes and following byte or
    prefix, which are 65,536 x 511 at most however large the corpus, and some hundred thousand in real texts.
    """
    cut = cut_of(depth)
    if not cut:
        return []
    mask = (1 << 8 * (cut - 1)) - 1

    @trimmed
    def tell(batches):
        for batch in batches:
            for steps, n in zip(batch.column("grams").to_pylist(), batch.column("n").to_pylist()):
                keys, n = unpacked_grams(steps), unpacked(n, "<i8")
                pair, place = np.unique(keys & ((mask << 8) | 0xFF), return_inverse=True)
                below = [branch(depth, keys[at], n[at]).levels[cut].below() for _, at in by_branches(keys, depth)]
                parent, prefix, told = (np.concatenate(x, axis=-1) for x in zip(*below))
                spot, where = np.unique((parent << 8) | prefix, return_inverse=True)
                added = [np.bincount(where, w, len(spot)) if len(spot) else np.zeros(0) for w in told]
                size = len(pair)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(np.zeros(size, bool), np.ones(len(spot), bool))),
                        pa.array(np.append(pair, spot)),
                        *[pa.array(np.append(a, b)) for a, b in zip((np.bincount(place, n, size), np.zeros(size), np.zeros(size)), added)],
                    ],
                    names=["below", "key", "x", "y", "z"],
                )

    found = branches.mapInArrow(tell, "below boolean, key long, x double, y double, z double").groupBy("below", "key").agg(*[F.sum(c).alias(c) for c in "xyz"]).toArrow()
    below, key, x, y, z = (c.to_numpy() for c in found.columns)
    below = below.astype(bool)
    levels, pair, n = [], key[~below], x[~below]
    for d in range(cut):
        pairs, place = np.unique(pair & ((((1 << 8 * d) - 1) << 8) | 0xFF), return_inverse=True)
        number = np.bincount(place, n, len(pairs)) if len(pairs) else np.zeros(0)
        context, at = np.unique(pairs >> 8, return_inverse=True)
        often = (np.bincount(at, number, len(context)) >= LEAST)[at] if len(pairs) else np.zeros(0, bool)
        levels.append(Level(d, pairs[often] >> 8, pairs[often] & 0xFF, number[often]))
    told = key[below] >> 8, key[below] & 0xFF, np.stack([x[below], y[below], z[below]])
    for level in reversed(levels):
        level.weigh(told)
        told = level.below() if level.depth else None
    return levels


def fit(df: DataFrame, learn: Column, text: str = "text", depth: int = 6, frequent: int = 1 << 19) -> LanguageModel:
    """Learn from all texts where ``learn`` holds; A-Z count as a-z, null as empty.

    All grams are counted, in tasks and then by bucket, and all of them are the model: a context seen twice or more is a
    node of its own, at any depth and in a corpus of any size. The number of buckets follows the bytes of
    text. Without training texts there are no grams, and each byte has an even chance.
    """
    held = df.filter(learn)
    size = held.agg(F.sum(F.octet_length(f"`{text}`"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    branches = saved(merged_buckets(gram_counts(held, text, depth, buckets)), "branches", "zstd")
    top = top_levels(branches, depth)
    words = saved(word_counts(held, text), "words")
    total = words.agg(F.sum("c").alias("words"), F.count(F.lit(1)).alias("distinct")).first()
    documents = held.count()
    tokens, distinct = (total["words"] or 0) + documents, total["distinct"] + (documents > 0)
    often = words.filter(F.col("c") >= max(tokens / frequent, 1)).toArrow()
    return LanguageModel(depth, buckets, branches, top, words, dict(zip(often.column("word").to_pylist(), often.column("c").to_pylist())), tokens, distinct, documents)


def asked_grams(texts: DataFrame, depth: int, buckets: int) -> DataFrame:
    """``(bucket, block, grams)``: the different grams of each block of ``texts(block, text)``, rows of a block side by side."""

    @trimmed
    def ask(batches):
        key, parts, held = None, [], 0

        def out():
            nonlocal parts, held
            if parts:
                keys = distinct(parts)
                for bucket, at in by_bucket(keys, depth, buckets):
                    columns = [pa.array([bucket], pa.int32()), pa.array([key], pa.int64()), pa.array([packed_grams(keys[at])], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "grams"])
            parts, held = [], 0

        for batch in batches:
            for part in slices(batch, "text"):
                blocks, texts = part.column("block").to_numpy(), lowered(part, "text")
                cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(texts)]
                for a, b in zip(cuts, cuts[1:]):
                    if blocks[a] != key:
                        yield from out()
                        key = int(blocks[a])
                    parts.append(distinct([grams(texts[a:b], depth)[0]]))
                    held += len(parts[-1])
                    if held > HELD + len(parts[0]):
                        parts = [distinct(parts)]
                        held = len(parts[0])
        yield from out()

    return texts.mapInArrow(ask, "bucket int, block long, grams binary")


def answered_grams(asked: DataFrame, model: LanguageModel) -> DataFrame:
    """``(block, grams, logs)``: log10 of the chance of each gram asked for, in single precision, from the branches of its bucket."""
    depth, top = model.depth, model.top
    none = F.lit(None).cast("binary")
    rows = model.branches.select("bucket", F.lit(-1).cast("long").alias("block"), "grams", "n").union(asked.select("bucket", "block", "grams", none.alias("n")))
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", F.col("n").isNull())

    @trimmed
    def answer(batches):
        key, trees = None, None
        for batch in batches:
            for bucket, block, steps, n in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != key:
                    key, trees = bucket, None
                    trim()
                keys = unpacked_grams(steps)
                if n is not None:
                    trees = Branches(depth, keys, unpacked(n, "<i8"), top)
                    continue
                if trees is None:  # nothing was learnt in this bucket
                    trees = Branches(depth, keys[:0], keys[:0], top)
                logs = trees.log10(keys).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([steps], pa.binary()), pa.array([packed(logs)], pa.binary())], names=["block", "grams", "logs"])

    return dealt.mapInArrow(answer, "block long, grams binary, logs binary")


def bundles(texts: DataFrame) -> DataFrame:
    """``(block, rows, texts)``: lowered texts of ``texts(block, row, text)``, a few megabytes compressed together, with their rows."""

    @trimmed
    def bundle(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                blocks, rows, texts = part.column("block").to_numpy(), part.column("row").to_numpy(), lowered(part, "text")
                cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(texts)]
                for a, b in zip(cuts, cuts[1:]):
                    # No UTF-8 text holds the edge.
                    held = _compressed(bytes([EDGE]).join(texts[a:b]))
                    columns = [pa.array([blocks[a]], pa.int64()), pa.array([rows[a:b].astype("<i8").tobytes()], pa.binary()), pa.array([held], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "rows", "texts"])

    return texts.mapInArrow(bundle, "block long, rows binary, texts binary")


def text_scores(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """``(row, score)`` for ``texts(block, row, text)``: log10 of the chance of each text and its end by the tree.

    A block's answers, of as many grams as its texts hold, come before its texts, which are scored as they pass.
    """
    depth = model.depth
    answers = answered_grams(asked_grams(texts.select("block", "text"), depth, model.buckets), model)
    none = F.lit(None).cast("binary")
    asked = bundles(texts).select("block", none.alias("grams"), none.alias("logs"), "rows", "texts")
    rows = answers.select("block", "grams", "logs", none.alias("rows"), none.alias("texts")).union(asked)
    dealt = rows.repartition("block").sortWithinPartitions("block", F.col("grams").isNull())

    @trimmed
    def score(batches):
        key, keys, logs, places = None, [], [], None
        for batch in batches:
            for i in range(batch.num_rows):
                block, steps, told, numbers, held = (c[i].as_py() for c in batch.columns)
                if block != key:
                    key, keys, logs, places = block, [], [], None
                    trim()
                if steps is not None:
                    keys.append(unpacked_grams(steps))
                    logs.append(unpacked(told, "<f4"))
                    continue
                if places is None:
                    keys, logs = np.concatenate(keys), np.concatenate(logs)
                    places = Places(keys)
                asked, sizes = grams(_restored(held).split(bytes([EDGE])), depth)
                found = logs[places.of(asked)].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(numbers, "<i8")), pa.array(sums(found, sizes))], names=["row", "score"])

    return dealt.mapInArrow(score, "row long, score double")


def score_texts(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` less its text, with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``bits_per_byte``.

    Tokens are words and one end for each text. ``score`` is the log10 probability of the lower-cased text
    and its end by the tree, ``bits_per_byte`` the same as a code length (over the bytes and the
    end). ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens. Null texts are empty
    and have one token; rows that repeat are scored alike; columns with these names are replaced.

    Frequent words are counted where the text is; the others meet the table of words in a
    join, as one row for each document and word, and come back as sums by row. The tree is asked by blocks of
    texts, see ``text_scores``; an empty table gives no rows.
    """
    frequent = {w: model.log_share(c) for w, c in model.frequent.items()}
    end = model.log_share(model.documents)
    end_known = int(model.documents > 0)
    outputs = "n_tokens long, near_known long, near_base double, n_bytes long, block long, rare array<binary>, times array<long>"

    open_block = {"bytes": BLOCK_BYTES, "first": 0}  # each task has its own

    def compute(batch):
        texts = lowered(batch, text)
        if open_block["bytes"] >= BLOCK_BYTES:
            open_block.update(bytes=0, first=batch.column("row")[0].as_py())
        open_block["bytes"] += sum(map(len, texts))
        words, n_words = split_words(batch, text)
        coded = words.dictionary_encode()
        different = coded.dictionary.cast(pa.binary())
        share = np.array([frequent.get(w, 0.0) for w in different.to_pylist()], np.float64)  # of a word that is met, below 0
        code, row = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(texts)), n_words)
        near = share[code] < 0
        known = end_known + np.bincount(row[near], minlength=len(texts))
        base = end + np.bincount(row, share[code], len(texts))
        far, times = np.unique(row[~near] * max(len(different), 1) + code[~near], return_counts=True)
        at, word = np.divmod(far, max(len(different), 1))
        ends = np.append(0, np.cumsum(np.bincount(at, minlength=len(texts)))).astype(np.int32)
        rare, times = (pa.ListArray.from_arrays(ends, x) for x in (different.take(pa.array(word)), pa.array(times, pa.int64())))
        n_bytes, first = [len(x) + 1 for x in texts], [open_block["first"]] * len(texts)
        return [*(pa.array(x, pa.int64()) for x in (n_words + 1, known)), pa.array(base), *(pa.array(x, pa.int64()) for x in (n_bytes, first)), rare, times]

    named = ["n_known", "train_tokens", "base_score", "bits_per_byte"]
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in named])
    others = [c for c in kept.columns if c != text and c.lower() not in ("n_tokens", "score")]
    # Numbers of rows are only relied on after they are written down.
    packed = kept.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("kept"), F.col(f"`{text}`").alias(text), F.monotonically_increasing_id().alias("row"))
    near = saved(extend(packed, text, outputs, compute), "scores", "zstd")
    by_tree = text_scores(near.select("block", "row", F.col(text).alias("text")), model)
    near = near.drop(text)

    rare = near.select("row", F.explode(F.arrays_zip("rare", "times")).alias("at")).select("row", F.col("at.rare").alias("word"), F.col("at.times").alias("n"))
    joined = rare.join(model.words, "word", "left")
    share = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(model.tokens + 0.5 * (model.distinct + 1)))
    far = joined.groupBy("row").agg(
        F.sum(F.col("n") * share).alias("far_base"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("far_known")
    )
    return near.join(by_tree, "row").join(far, "row", "left").select(
        *[F.col("kept")[c].alias(c) for c in others],
        "n_tokens",
        (F.col("near_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("near_base") + F.coalesce("far_base", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
