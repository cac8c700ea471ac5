"""Arrow batches of bounded size for tasks that parse texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are parsed at once; a longer text stays whole.
BYTES = 1 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Batches whose texts in ``column`` have about ``limit`` bytes."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)) if batch.num_rows else np.zeros(0, np.int64)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(size[at:], dtype=np.int64), limit, side="right")))
            yield batch.slice(at, n)
            at += n
