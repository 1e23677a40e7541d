"""Arrow batches in pieces of bounded size, for steps that hold several forms of a text at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that a step takes apart together.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], limit: int = PIECE_BYTES, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in runs of at most ``limit`` bytes of a column of texts; a longer text is a run of
    its own. Nothing is copied."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            then = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, then - at)
            at = then
