"""Token ids as flat binary files with 64-bit document offsets.

A dataset is a folder of shards and a table that lists them. A shard has three files of plain
little-endian numbers: ``.tokens`` (unsigned ids, 16 bits where the vocabulary allows it, else 32),
``.offsets`` (64-bit; where each document begins in the shard, and the end) and ``.docs`` (the
64-bit document ids, ``NO_ID`` for null). Shards follow each other in the order of ids; the table
gives each its number of tokens, and the prefix sums of these are the shards' bases.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datelore.llm.common import saved, texts_of
from datelore.llm.words import word_encoder

NO_ID = -(1 << 63)
#: Documents that a task reads back; a shard with more is read by several.
PIECE = 1 << 14


def file_system(uri: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_token_shards(df: DataFrame, folder: str, vocabulary: str, end_id: int | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, write shards in ascending order of ids; returns the table of shards.

    Null and empty texts have no ids but the end id. Rows with equal ids all stay, in the order of
    their texts; null ids come first. Other columns are not written. An empty table writes no shard.

    Rows are dealt by range of id and sorted; each task appends to its own shard as batches
    arrive. File names are new for each attempt and the table of shards names those of the
    attempts that ended well, so that lost executors leave at most files nobody reads.
    """
    rows = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    dealt = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")

    def write(batches):
        encoder, shard = word_encoder(vocabulary), TaskContext.get().partitionId()
        ending = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        name, streams = f"shard-{shard:06d}-{uuid.uuid4().hex}", None
        docs, written = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if streams is None:
                files, path = file_system(folder)
                files.create_dir(path, recursive=True)
                streams = [files.open_output_stream(f"{path}/{name}.{kind}") for kind in ("tokens", "offsets", "docs")]
            ids = [encoder.encode(x) + ending for x in texts_of(batch, "text")]
            ends = written + np.cumsum([len(x) // encoder.dtype.itemsize for x in ids])
            streams[0].write(b"".join(ids))
            streams[1].write(np.concatenate([[written], ends[:-1]]).astype("<i8").tobytes())
            streams[2].write(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            written, docs = int(ends[-1]), docs + len(ids)
        if streams is not None:
            streams[1].write(np.array([written], "<i8").tobytes())
            for stream in streams:
                stream.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "bits": [8 * encoder.dtype.itemsize], "n_docs": [docs], "n_tokens": [written]})

    return saved(dealt.mapInArrow(write, "shard long, name string, bits long, n_docs long, n_tokens long"), "shards")


def read_token_shards(shards: DataFrame, folder: str, id: str = "doc_id") -> DataFrame:
    """One row for each document of the files: id, ``start`` (ids before it in all shards), ``n_tokens`` and ``ids`` (unsigned 32-bit little-endian).

    Bases are the prefix sums over the table of shards, one row each. Shards are cut into ranges of ``PIECE``
    documents, each of which is a task of its own, as many as there are; files are memory-mapped where the
    folder is a local or mounted one, else the bytes of the range are read. No shards give no rows.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    firsts = F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(PIECE).cast("long"))
    pieces = saved(based.withColumn("first", F.explode(firsts)), "pieces")
    tasks = max(pieces.count(), 1)

    def read(batches):
        files, path = file_system(folder)
        local = folder.startswith("file:")

        def numbers(name: str, kind: str, dtype: str, a: int, b: int):
            """The numbers from ``a`` to ``b`` of a file."""
            size = np.dtype(dtype).itemsize
            if b <= a:
                return np.zeros(0, dtype)
            if local:
                return np.memmap(f"{path}/{name}.{kind}", dtype, "r", a * size, (b - a,))
            with files.open_input_file(f"{path}/{name}.{kind}") as file:
                return np.frombuffer(file.read_at((b - a) * size, a * size), dtype)

        for batch in batches:
            for row in batch.to_pylist():
                first, last = row["first"], min(row["first"] + PIECE, row["n_docs"])
                offsets, docs = numbers(row["name"], "offsets", "<i8", first, last + 1), numbers(row["name"], "docs", "<i8", first, last)
                opening = int(offsets[0])
                tokens = numbers(row["name"], "tokens", f"<u{row['bits'] // 8}", opening, int(offsets[-1]))
                for a in range(0, len(docs), 1000):
                    some = np.array(docs[a : a + 1000])
                    cuts = np.array(offsets[a : a + len(some) + 1])
                    flat = tokens[cuts[0] - opening : cuts[-1] - opening].astype("<u4").tobytes()
                    at = 4 * (cuts - cuts[0])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some, mask=some == NO_ID),
                            pa.array(row["base"] + cuts[:-1]),
                            pa.array(np.diff(cuts)),
                            pa.array([flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()),
                        ],
                        names=[id, "start", "n_tokens", "ids"],
                    )

    return pieces.repartitionByRange(tasks, "shard", "first").mapInArrow(read, f"`{id}` long, start long, n_tokens long, ids binary")
