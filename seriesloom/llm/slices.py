"""Arrow batches in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def bounded(batch: pa.RecordBatch, column: int, most_bytes: int, most_rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most `most_bytes` in a text column; one row at least."""
    if not batch.num_rows:
        return
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = int(np.searchsorted(ends, done + most_bytes, side="right"))
        to = min(max(to, at + 1), at + most_rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
