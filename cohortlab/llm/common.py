"""Helpers shared by the text operators: Arrow batches in tasks, packed texts, row keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one column a task works on at a time; a single longer text is worked on alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, so that a batch of very long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * SLICE_BYTES))


def texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty), whatever else the table has."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def same(a: Column, b: Column) -> Column:
    """Equality under which nulls match."""
    return a.eqNullSafe(b)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = packed(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(off, off[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column end to end, and the n+1 offsets of its rows; null is empty."""
    large = pa.large_binary()
    column = pc.fill_null(column.cast(large), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, off - off[0]


def longs(column: pa.Array) -> np.ndarray:
    """A column of longs; null becomes the smallest long, which sorts first."""
    return pc.fill_null(column, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)
