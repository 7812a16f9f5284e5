"""Arrow batches cut to a bounded number of text bytes, so a worker's memory does not depend on rows."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

T = TypeVar("T")


def release() -> None:
    """Gives freed memory back to the system; Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: What this process keeps from task to task: the tokenizer or model of one operator, with its cache.
_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], T]) -> T:
    """The object of this key, made once; that of another key goes first, as workers serve one operator after another."""
    if key not in _held:
        drop_held()
        _held[key] = make()
    return _held[key]


def drop_held() -> None:
    if _held:
        _held.clear()
        release()


def bounded(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, holds: bool = False) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose `column` holds about max_bytes (one longer value stands alone).

    An operator that holds nothing itself frees what another one left in this process.
    """
    if not holds:
        drop_held()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def binary_array(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
