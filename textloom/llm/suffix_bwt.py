"""Burrows-Wheeler transform and common prefixes of many short strings, built column by column.

Each round inserts one symbol per string, from the last to the first. The list of suffixes inserted
so far is kept in sequential files, ordered by first symbol; a round reads them twice from front to
back and writes them once. The symbol before a suffix gives the place of the longer suffix: its rank
among equal symbols. The common prefix of two neighbours of a new block is one more than the least
common prefix between the two suffixes they extend.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np

DONE = 255  # the symbol before a whole string
GROUP = 1 << 19  # suffixes held at once, or one block


@dataclass
class Suffixes:
    """All suffixes in order: their string, their length and the common prefix with the one before."""

    string: np.ndarray
    length: np.ndarray
    common: np.ndarray


class _Least:
    """Least values of ranges of an array of bytes, by a table of all ranges of powers of two."""

    def __init__(self, values: np.ndarray, longest: int):
        levels, size = [values], 1
        while 2 * size <= longest:
            levels.append(np.minimum(levels[-1][:-size], levels[-1][size:]))
            size *= 2
        self.starts = np.cumsum([0, *(len(x) for x in levels)])
        self.table = np.concatenate(levels)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over a..b, both included; ``a`` <= ``b``."""
        level = np.frexp((b - a + 1).astype(float))[1] - 1
        start = self.starts[level]
        return np.minimum(self.table[start + a], self.table[start + b - (1 << level) + 1])


class _File:
    """The list of suffixes in groups of blocks: symbols, common prefixes, lengths and strings."""

    def __init__(self, path: str):
        self.file = open(path, "w+b")  # noqa: SIM115

    def write(self, blocks) -> list[int]:
        sizes = []
        self.file.seek(0)
        for columns in blocks:
            sizes.append(len(columns[0]))
            for c in columns:
                self.file.write(memoryview(c).cast("B") if len(c) else b"")
        self.file.flush()
        return sizes

    def read(self, sizes: list[int], bytes_each: int = 7):
        """Groups from front to back; with two bytes each only symbols and common prefixes."""
        at = 0
        for n in sizes:
            self.file.seek(at)
            raw = np.frombuffer(self.file.read(bytes_each * n), np.uint8)
            at += 7 * n
            yield raw[:n], raw[n : 2 * n], raw[2 * n : 3 * n], raw[3 * n :].view(np.uint32) if bytes_each == 7 else None


def build(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, folder: str) -> Suffixes:
    """Suffixes of the strings ``data[start : start + length]``, of 1 to 254 symbols each, in sorted order.

    Symbols are bytes. Equal suffixes are ordered by string. Files go to ``folder`` and stay small
    enough for it: seven bytes per symbol, twice.
    """
    count = len(starts)
    used = np.unique(data)
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(len(used))
    symbols = len(used)
    text = code[data]
    ends = starts + lengths
    groups = _groups(np.bincount(text, minlength=symbols))
    blocks = np.zeros(symbols, np.int64)  # suffixes that start with each symbol
    old, new = _File(os.path.join(folder, "a")), _File(os.path.join(folder, "b"))
    sizes = old.write([(np.zeros(0, np.uint8),) * 3 + (np.zeros(0, np.uint32),)] * len(groups))
    first_symbols = text[ends - 1]  # before the empty suffixes, in the order of the strings
    fresh: list[tuple[np.ndarray, np.ndarray]] = []  # per group: places of the suffixes of the last round, their strings
    for t in range(1, int(lengths.max(initial=0)) + 1):
        before = np.zeros(symbols, np.int64)
        found = []  # symbol, place in its block, common prefixes with both neighbours, string
        if t == 1:
            ids = np.arange(count)
            found.append(_located(first_symbols, np.zeros(count, np.uint8), ids, ids, before))
        else:
            # The empty suffixes come first; their symbols are in use since the first round.
            before += np.bincount(first_symbols, minlength=symbols)
            for (sym, common, _, _), (place, ids) in zip(old.read(sizes, 2), fresh, strict=True):
                going = sym[place] != DONE
                if going.any():
                    found.append(_located(sym, common, place[going], ids[going], before))
                before += np.bincount(sym, minlength=256)[:symbols]
        if not found:
            break
        sym, place, above, below, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, sym))
        sym, place, above, below, ids = sym[order], place[order], above[order], below[order], ids[order]
        blocks = blocks + np.bincount(sym, minlength=symbols)
        starts_of = np.cumsum(blocks) - blocks
        at = ends[ids] - t - 1
        previous = np.where(lengths[ids] > t, text[np.maximum(at, 0)], DONE).astype(np.uint8)
        inner = place + 1 < blocks[sym]  # another suffix of the block follows
        fresh = []

        def merged():
            for (low, high), was in zip(groups, old.read(sizes), strict=True):
                part = slice(*np.searchsorted(sym, (low, high)))
                q = starts_of[sym[part]] - starts_of[low] + place[part]
                fresh.append((q, ids[part]))
                if not len(q):
                    yield was
                    continue
                total = len(was[0]) + len(q)
                kept = np.ones(total, bool)
                kept[q] = False
                out = [np.empty(total, x.dtype) for x in was]
                for x, old_values, values in zip(out, was, (previous[part], above[part], t, ids[part]), strict=True):
                    x[kept] = old_values
                    x[q] = values
                out[1][q[inner[part]] + 1] = below[part][inner[part]]
                yield tuple(out)

        grown = new.write(merged())
        sizes, old, new = grown, new, old
    columns = list(old.read(sizes))
    return Suffixes(*(np.concatenate([c[k] for c in columns]) if columns else np.zeros(0, np.uint8) for k in (3, 2, 1)))


def _groups(counts: np.ndarray) -> list[tuple[int, int]]:
    """Neighbouring blocks that are read at once: from and to symbols."""
    out, low, held = [], 0, 0
    for c, n in enumerate(counts.tolist()):
        if held and held + n > GROUP:
            out.append((low, c))
            low, held = c, 0
        held += n
    return [*out, (low, len(counts))]


def _located(sym: np.ndarray, common: np.ndarray, place: np.ndarray, ids: np.ndarray, before: np.ndarray):
    """Where the suffixes that extend those at ``place`` go, and their common prefixes with both neighbours there.

    Groups start with a new symbol, so a neighbour from another group shares one symbol and no more.
    """
    order = np.argsort(sym, kind="stable")
    inverse = np.empty(len(sym), np.int64)
    inverse[order] = np.arange(len(sym))
    group = np.concatenate([[0], np.cumsum(np.bincount(sym, minlength=256))])
    own = sym[place].astype(np.int64)
    k = inverse[place]
    has_last, has_next = k > group[own], k + 1 < group[own + 1]
    last, following = order[k[has_last] - 1], order[k[has_next] + 1]
    a = np.concatenate([last + 1, place[has_next] + 1])
    b = np.concatenate([place[has_last], following])
    above = np.where(before[own] > 0, 1, 0).astype(np.uint8)
    below = np.ones(len(place), np.uint8)
    if len(a):
        least = _Least(common, int((b - a).max()) + 1).between(a, b) + 1
        above[has_last], below[has_next] = least[: len(last)], least[len(last) :]
    return own, before[own] + k - group[own], above, below, ids
