"""Small pieces for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 * 1024 * 1024


def slices(batches: Iterator[pa.RecordBatch], *texts: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``limit`` bytes of text each; a row with more is a part of its own."""
    for batch in batches:
        sizes = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < batch.num_rows:
            stop = min(max(at + 1, int(ends.searchsorted(ends[at] + limit, "right")) - 1), batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


# Letters, digits and the underscore of ASCII and all bytes of other characters stay; other ASCII characters become blanks.
_BLANKED = bytes(b if b >= 128 or chr(b).isalnum() or b == ord("_") else ord(" ") for b in range(256))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text and all words, for texts of ``tx.ascii_gaps``, without nulls."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, body = texts.buffers()
    at = np.frombuffer(offsets, wide)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, wide)
    data = bytes(memoryview(body)[at[0]:at[-1]]).translate(_BLANKED) if body is not None else b""
    blanked = type(texts).from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(data))
    return _filled(pc.ascii_split_whitespace(blanked))


def split_blanks(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text and all words, for texts of words with one blank between them, without nulls."""
    return _filled(pc.split_pattern(texts, " "))


def _filled(words: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Sizes and values of lists, without empty values."""
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    values = words.flatten()
    filled = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
    if filled.all():
        return sizes, values
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(rows[filled], minlength=len(sizes)), values.filter(pa.array(filled))
