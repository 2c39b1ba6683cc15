"""Arrow batches of texts in slices of bounded size, so that a worker's memory does not follow the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most bytes of text and most rows in one slice; a longer text is a slice of its own.
BYTES, ROWS = 1 << 20, 4096


def bounds(columns: list[pa.Array], most: int = BYTES) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of consecutive slices of string columns of equal length."""
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = min(max(start + 1, int(np.searchsorted(ends, before + most, side="right"))), start + ROWS)
        yield start, end - start
        start = end
