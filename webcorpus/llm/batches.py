"""Arrow batches cut to a size a Python worker can hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` text bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def utf8(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each text starts (one more entry for the end)."""
    array = pc.fill_null(batch.column(column), "").cast(pa.large_binary())
    array = pa.concat_arrays([array])
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def ranges(data: np.ndarray, limit: int, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``limit`` bytes; a cut inside a text is after a byte that ``ends`` (by value) marks."""
    start = 0
    while len(data) - start > 2 * limit:
        stop = start + limit
        while stop < len(data):
            found = np.flatnonzero(ends[data[stop:stop + limit]])
            if len(found):
                stop += int(found[0]) + 1
                break
            stop += limit
        yield start, min(stop, len(data))
        start = min(stop, len(data))
    yield start, len(data)
