"""Arrow batches in parts of bounded size, so that a worker's memory does not grow with the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and text bytes of a part; a single longer text is a part of its own.
PART_ROWS = 1_000
PART_BYTES = 4 << 20


def parts(batch: pa.RecordBatch, column: int | str, rows: int = PART_ROWS, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` in order, cut by rows and by the bytes of ``column`` (strings or binaries)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at, n = 0, batch.num_rows
    while at < n:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


def by_parts(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], column: int | str, rows: int = PART_ROWS, size: int = PART_BYTES):
    """A ``mapInArrow`` function: ``make()`` gives a task's function of one part; freed Arrow memory goes back at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for part in parts(batch, column, rows, size):
                yield one(part)
        pa.default_memory_pool().release_unused()

    return run
