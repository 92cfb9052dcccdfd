"""Shared pieces of the training-data operators: written intermediate tables, batching, and what the library offers for both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.sources.tables import new_folder, shared_dir, table

__all__ = ["materialise", "new_folder", "portions", "shared_dir", "table"]

#: Bytes of text that a Python worker handles at once; bounds its memory whatever the batch size.
SLICE_BYTES = 4 << 20


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def portions(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Views of ``batch`` whose texts in ``column`` have about ``limit`` bytes together; a longer text stands alone.

    The cuts come from Arrow's offsets, so no text becomes a Python string before its part is reached.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    stops, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        before = stops[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(stops, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end
