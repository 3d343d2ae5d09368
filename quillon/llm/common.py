"""What the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.session import ship

#: Arrow batches to and from Python workers hold at most about so many bytes;
#: a single longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so that a worker's memory
    does not depend on how long the texts are.  The setting is the session's, as
    plans run after this returns; a lower bound of the user's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not (now and now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with bounded batches and this package on the workers."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            released()

    return df.mapInArrow(run, schema)


def released() -> None:
    """Give freed memory back: workers live on between tasks, and what their
    allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, text: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part's column ``text`` has at most ``limit``
    bytes, or one row."""
    n = batch.num_rows
    if not n:
        return
    column = batch.column(text)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset :][: n + 1].astype(np.int64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def texts_of(column: pa.Array) -> list[str]:
    """Texts, with null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of texts, with null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads, whatever others there are."""
    return df.select(*(F.col(f"`{n}`") for n in names))
