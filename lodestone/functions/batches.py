"""Slices of Arrow batches, so that what a task makes of them at a time is bounded."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows in order, so many at a time that ``column`` has about ``limit`` bytes of text, or items of lists; one row at least."""
    for b in batches:
        c = b.column(column)
        size = pc.list_value_length(c) if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else pc.binary_length(c)
        size = np.asarray(pc.fill_null(size, 0), np.int64)
        cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit)) + 1
        edges = [0, *cut.tolist(), b.num_rows]
        for start, stop in zip(edges, edges[1:]):
            yield b.slice(start, stop - start)
