"""Arrow batches in Python workers: slices of bounded size, and memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIBC = ctypes.CDLL(None)
#: Bytes of text in a slice.
PIECE = 1 << 20


def trim() -> None:
    """Gives freed memory back: workers live on after a task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, trimmed at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def pieces(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole rows with about PIECE bytes of text each (a longer row stands alone)."""
    for b in batches:
        upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0), np.int64) + 64)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PIECE, "right")))
            yield b.slice(i, j - i)
            i = j
