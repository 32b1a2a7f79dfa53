"""Scratch tables and bounded joins of the core, and slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from ..scratch import bounded_join, drop, narrow, saved, shared_dir

__all__ = ["bounded_join", "drop", "in_slices", "narrow", "saved", "shared_dir", "wide"]


def wide(df: DataFrame, per_core: int = 3) -> int:
    """Partitions for work that is heavy on CPU rather than on bytes, which AQE would otherwise merge by size: the
    session's shuffle partitions, and a few for each core at least."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism)


def in_slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice has at most so many rows, and more than one row only if its text stays under `size` bytes."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        while at < n:
            end, total = at, 0
            while end < n and end - at < rows and (end == at or total + lengths[end] <= size):
                total += lengths[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end
