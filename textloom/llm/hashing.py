"""Vectorised hashes of words and byte windows over Arrow text buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from textloom.llm.arrow import text_ends

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd, hence invertible
STEP = U(0xD6E8FEB86659FD93)
BLOCK = 1 << 19
_draw = np.random.default_rng(20240229)
BYTES = _draw.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each, starting at 0. Nulls are not allowed."""
    ends = text_ends(texts)
    data = texts.buffers()[2]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, U), np.full(n, U(pow(int(BASE), -1, 1 << 64)), U)
    up[0] = down[0] = U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(BLOCK)


def words(data: np.ndarray, ends: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of bytes that are not ``between`` words, inside each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~between[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = ends[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lowered."""
    return mix(prefix_hashes(data, starts, stops, ())[0])


def prefix_hashes(
    data: np.ndarray, starts: np.ndarray, stops: np.ndarray, widths: tuple[int, ...], lower: bool = True,
) -> list[np.ndarray]:
    """A hash of each word and of its first ``widths`` bytes, A-Z lowered if asked. Words come in order.

    Differences of prefix sums, block by block of whole words.
    """
    values = BYTES[LOWER] if lower else BYTES
    out = [np.empty(len(starts), U) for _ in range(1 + len(widths))]
    at = 0
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(stops, base + BLOCK, "right")))
        span = int(stops[stop - 1] - base)
        up, down = (_UP, _DOWN) if span <= BLOCK else _powers(span)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(values[data[base : base + span]] * up[:span], dtype=U)])
        a, b = starts[at:stop] - base, stops[at:stop] - base
        for k, width in enumerate((None, *widths)):
            end = b if width is None else np.minimum(b, a + width)
            out[k][at:stop] = (sums[end] - sums[a]) * down[a] + (end - a).astype(U)
        at = stop
    return out


def sequence_hash(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` neighbouring words."""
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out = mix(out * STEP + h[k : k + n])
    return out
