"""Arrow batches worked on in slices of bounded rows and bytes, whatever the session's own bounds are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows and bytes of strings that a worker turns into Python objects at a time; one longer text goes alone.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of bounded rows and bytes, without copying; the session's own bounds on batches stay as they are."""
    lengths = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            lengths += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, stop - at)
        at = stop
    if not batch.num_rows:
        yield batch


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function that ``make`` builds once in each task, over batches of bounded rows and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in sliced(batches):
            yield f(batch)

    return df.mapInArrow(run, schema)


def by_row(columns: tuple[pa.Array, ...], f: Callable, kind: pa.DataType) -> pa.Array:
    """``f`` of each row's values, of which a bounded slice at a time are Python objects."""
    batch = pa.RecordBatch.from_arrays(list(columns), names=[str(i) for i in range(len(columns))])
    parts = [pa.array([f(*row) for row in zip(*(c.to_pylist() for c in part.columns))], kind) for part in slices(batch)]
    return pa.concat_arrays(parts)
