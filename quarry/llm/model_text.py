"""Arrow-batched access to texts for the operators that need Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def texts(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches, cut so that the column text holds about `most` bytes at a time (one text may be longer); null: ''."""
    for batch in batches:
        size = np.array([len(x) if x is not None else 0 for x in (s.as_buffer() if s.is_valid else None for s in batch["text"])], dtype=np.int64)
        part, at = np.cumsum(size) // most, 0
        for stop in [*(np.flatnonzero(np.diff(part)) + 1), len(size)]:
            if stop > at:
                cut = batch.slice(at, stop - at)
                yield cut, [t or "" for t in cut["text"].to_pylist()]
            at = stop
