"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 6 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``most`` bytes of ``column``.

    A text longer than that is a piece of its own: memory follows the longest
    text, not the number of rows.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype="i8") // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The elements of a list column and the offsets of its rows (null rows are empty)."""
    lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
    offsets = lists.offsets.to_numpy()
    return lists.flatten(), (offsets - offsets[0]).astype("i8")


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of every element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def strings(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    return arr if arr.type == pa.string() else arr.cast(pa.string())
