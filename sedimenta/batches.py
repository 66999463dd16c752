"""Arrow batches in parts of bounded size: what a Python worker holds at once does not grow with the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time, and rows, whatever their size; one longer text is a part of its own.
PART_BYTES = 500_000
PART_ROWS = 1_000


def parts(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with up to PART_BYTES in the string column at place, in the same order."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            end = min(max(at + 1, int(np.searchsorted(ends, done + PART_BYTES, "right"))), at + PART_ROWS)
            end = min(end, b.num_rows)
            yield b.slice(at, end - at)
            at = end
