"""Small helpers the operators share: Arrow text as bytes, scratch tables, held-out folds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import checkpoint_dir

#: Bytes of text handled at once by the vectorised helpers.
SLICE_BYTES = 2_000_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table written once to the shared folder and read back, and its place."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of about ``size`` in the jobs run inside: rows of whole texts or sets are large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep_batches_small(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of about ``size`` from here on, results that run later included; a size given on purpose stays.

    Ten thousand rows of whole texts are held several times over otherwise, and a worker that once held them does not shrink.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, size)


def dealt(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Few small rows that each stand for much work (files, byte ranges), dealt in turn to as many tasks as rows.

    Dealt by a key without a number, so little data would be put together in
    one task again.  Rows of several input tasks may meet in one; beyond
    ``most`` tasks they always do.
    """
    return rows.repartition(min(max(rows.count(), 1), most))


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind each other and their n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, place, data = column.buffers()
    offsets = np.frombuffer(place, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text (one row at least)."""
    _, offsets = text_bytes(batch.column(text))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop
