"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datelore.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space that separates words: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: Upper case A-Z to lower case, for bytes.translate.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Input that Python works on together.
BYTES_AT_ONCE = 2 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as a table in the shared folder and read again, which ends its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Only A-Z in lower case; texts of plain ASCII take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(id: str, parts: int) -> Column:
    """crc32 of an id's text modulo ``parts``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))) % parts


def row_keys(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns, never null: 128 bits tell any number of rows apart."""
    return F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns with these names, in any case."""
    taken = {name.lower() for name in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts or lists of numbers take about ``BYTES_AT_ONCE``; a larger one is a run of its own."""
    held = batch.column(column)
    length = pc.binary_length(held) if not pa.types.is_list(held.type) else pc.multiply(pc.list_value_length(held), 4)
    ends = np.cumsum(length.fill_null(0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE, "right")))
        yield batch.slice(a, b - a)
        a = b


def extend(df: DataFrame, column: str, outputs: str, compute: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """``df`` with the columns of the DDL string ``outputs``, which ``compute`` derives from batches of rows.

    ``compute`` takes an Arrow batch of some rows, cut by the size of ``column``, and
    returns the output arrays. A column of ``df`` with the name of an output is replaced.
    """
    added = T._parse_datatype_string(outputs)
    kept = without(df, added.fieldNames())
    schema = T.StructType(kept.schema.fields + added.fields)
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_arrays([*part.columns, *compute(part)], names=names)

    return kept.mapInArrow(run, schema)


def for_worker(name: str, make: Callable):
    """An object made once and kept for the life of a Python worker, such as a loaded vocabulary."""
    store = sys.modules.setdefault("datelore_worker_objects", types.ModuleType("datelore_worker_objects"))
    if name not in store.__dict__:
        store.__dict__[name] = make()
    return store.__dict__[name]


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """The texts of a batch, null as the empty text."""
    return ["" if x is None else x for x in batch.column(text).to_pylist()]
