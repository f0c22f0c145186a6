"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python lists that go back to Spark are flushed at about this many bytes.
FLUSH_BYTES = 2 << 20
#: Rows to an Arrow batch: rows hold whole texts, and Spark's default of 10,000 of them is too much memory.
BATCH_ROWS, BATCH_BYTES = 1000, "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Memo(dict):
    """A bounded memo: it is emptied when it holds ``most`` entries."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def lean(run: Callable) -> Callable:
    """``run``, a function over batches for mapInArrow, after which the worker gives memory that it no longer uses back.

    Spark uses workers again for later stages; what their allocators kept would add up beside the executor's heap.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, column: str, most: int = FLUSH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about ``most`` bytes in ``column`` (one row at least)."""
    sizes = batch.column(column).to_pylist() if pa.types.is_integer(batch.schema.field(column).type) else None
    if sizes is None:
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n + 64
    if start < batch.num_rows:
        yield batch.slice(start)


def whole_texts(df: DataFrame) -> DataFrame:
    """``df``, with small Arrow batches set for its session; for use before mapInArrow."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
