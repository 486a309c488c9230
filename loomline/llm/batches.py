"""Arrow batches of bounded text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text makes a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose texts in `column` have at most `limit` bytes together, or a single row."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < b.num_rows:
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + limit, "right")))
            yield b.slice(start, end - start)
            start = end
