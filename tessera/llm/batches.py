"""Arrow batches in smaller parts, and memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa

ROWS = 1000
try:
    trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # only glibc has it
    trim = None


def give_back() -> None:
    """Returns freed memory to the system; a worker lives on, and its next task may be another stage's."""
    pa.default_memory_pool().release_unused()
    if trim:
        trim(0)


def slices(batches: Iterator[pa.Array], rows: int = ROWS) -> Iterator[pa.Array]:
    """Parts of at most so many rows, so that what a worker makes of a batch stays small; freed memory is given back."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
        del batch
        give_back()
