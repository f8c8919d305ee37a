"""Arrow batches in small pieces, so that what a task makes of a batch is never held for all its rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows of a piece.
ROWS = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in their order, at most ``ROWS`` at a time, without a copy."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
