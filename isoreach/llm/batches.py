"""Arrow batches cut by bytes, so that a task's memory does not follow the length of its texts, and memory given back."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_bytes(batches: Iterator, column: str, most_bytes: int = 4 << 20, most_rows: int = 1000) -> Iterator:
    """Slices of batches or tables, of at most ``most_rows`` rows and ``most_bytes`` bytes
    of ``column``; a longer value is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            before = ends[first] - sizes[first]
            last = int(np.searchsorted(ends, before + most_bytes, side="right"))
            last = min(max(last, first + 1), first + most_rows, len(sizes))
            yield batch.slice(first, last - first)
            first = last


def give_back() -> None:
    """Returns free memory to the system: workers outlive a task, and the next operator needs it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on batches, after which the worker gives its free memory back."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run
