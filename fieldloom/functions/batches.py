"""Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that become Python objects at a time.
PIECE_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch, *texts: str) -> Iterator[pa.RecordBatch]:
    """Slices whose columns ``texts`` have about ``PIECE_BYTES`` bytes each, or one row that has more."""
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), dtype=np.int64) for c in texts) + 64
    place = np.cumsum(sizes) // PIECE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(column):
        return flat.reshape(0, 0)
    if len(flat) % len(column) or column.null_count or pc.min_max(pc.list_value_length(column))["min"].as_py() * len(column) != len(flat):
        raise ValueError("vectors must have one length")
    return flat.reshape(len(column), -1)


def one_batch(table: pa.Table) -> pa.RecordBatch:
    """A table of at least one row as a single batch."""
    return table.combine_chunks().to_batches()[0]


def loaded(kept: Any) -> Any:
    """The value of a broadcast, which isn't kept in the worker: a task that goes through several holds one at a time."""
    value = kept.value
    kept.__dict__.pop("_value", None)
    return value
