"""Small pieces for functions over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 * 1024 * 1024


def text_ends(texts: pa.Array) -> np.ndarray:
    """Byte positions between the texts in the array's data buffer."""
    if not len(texts):
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def _trim():
    """The C library's call that returns free memory to the system, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Return memory that is free by now, so that a worker that lives on does not hold its largest moment."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``limit`` bytes of text each; a longer text is a part of its own.

    Memory that is free goes back to the system after each batch.
    """
    for batch in batches:
        ends = text_ends(batch.column(column))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(ends.searchsorted(ends[at] + limit, "right")) - 1)
            stop = min(stop, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop
        release()
