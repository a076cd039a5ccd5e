"""Arrow batches in and out of Python, cut so that memory stays bounded whatever the texts' lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that a function gets at once. A longer text comes alone, and whole.
CHUNK_BYTES = 3 << 20


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about `most` bytes of text each, in order, none empty."""
    sizes = np.asarray(batch.column(column).cast(pa.large_string()).fill_null("").buffers()[1]).view(np.int64)
    start = 0
    offset = batch.column(column).offset
    ends = sizes[offset + 1 : offset + 1 + batch.num_rows] - (sizes[offset] if batch.num_rows else 0)
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_text(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow with a function of one chunk; None gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column, most):
                out = function(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from the concatenated values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
