"""Runs of periodic words, found through string synchronising sets.

At each dyadic scale ``t`` a hash of ``t`` words selects positions: a place is selected if the least
hash among the ``t + 1`` windows that begin at it and after it stands at either end. That depends on
the next ``2 t`` words alone, so equal contexts are selected alike, and any ``t`` neighbouring places
hold a selected one unless all windows there are left out as highly periodic. A run of period ``q``,
``t < q <= 2 t``, and length ``4 q`` therefore holds a selected place and the same context ``q`` words
on, and no sooner, as the period is the smallest. Such pairs propose ``q``; comparing words
``q`` apart then decides, so no hash decides a result.

Windows are highly periodic if they lie in runs with periods of at most ``t / 4``. Those runs are
known from smaller scales by then, and periods 1 and 2, which have no scale, are found by comparing
neighbours directly.

All documents of a slice are treated at once, each closed by a symbol of its own, so that no context
reaches from one to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.arrow import slices
from textloom.llm.common import with_ids
from textloom.llm.hashing import SPACE, STEP, U, buffers, mix, words

EXPONENT = 4  # of a run at least
SHORTEST = 6  # words of a run at least
RUNS = "array<struct<start:bigint, length:bigint, period:bigint>>"


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of each text, equal for equal words of all texts, and where each text's words end."""
    data, ends = buffers(texts)
    starts, stops = words(data, ends)
    bounds = np.concatenate([[0], np.cumsum(stops - starts)])
    kept = data[~SPACE[data]]
    big = bounds[-1] > 2**31 - 1
    kind = pa.large_binary() if big else pa.binary()
    offsets = pa.py_buffer(bounds.astype(np.int64 if big else np.int32))
    array = pa.Array.from_buffers(kind, len(starts), [None, offsets, pa.py_buffer(kept)])
    codes = array.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return codes.astype(np.int64), np.searchsorted(starts, ends[1:])


def find_runs(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All runs as rows ``start, stop, period`` of places in ``codes``, by start, then period.

    A run is a stretch that neither neighbour extends, whose smallest period fits ``EXPONENT`` times
    or more into it and that has ``SHORTEST`` words or more.
    """
    sizes = np.diff(np.concatenate([[0], ends]))
    number = np.repeat(np.arange(len(sizes)), sizes)
    text = np.empty(len(codes) + len(sizes), np.int64)
    place = np.arange(len(codes)) + number
    text[place] = codes
    closing = ends + np.arange(len(sizes))
    text[closing] = -1 - np.arange(len(sizes))
    firsts = closing - sizes
    found = [_direct(text, q) for q in (1, 2)]
    scale, keep = 2, sizes >= EXPONENT * 3
    while keep.any():
        found.append(_at_scale(text, firsts[keep], closing[keep], scale, np.concatenate(found)))
        scale *= 2
        keep = sizes >= EXPONENT * (scale + 1)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)  # a multiple of the smallest period has the same stretch
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    runs = runs[runs[:, 1] - runs[:, 0] >= SHORTEST]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    shift = np.searchsorted(closing, runs[:, 0], "left")  # closing symbols before
    runs[:, 0] -= shift
    runs[:, 1] -= shift
    return runs


def _direct(text: np.ndarray, q: int) -> np.ndarray:
    """Maximal stretches of period ``q`` and length ``EXPONENT * q`` or more."""
    if len(text) <= q:
        return np.zeros((0, 3), np.int64)
    same = np.zeros(len(text) - q + 2, np.int8)
    same[1:-1] = text[q:] == text[:-q]
    turn = np.flatnonzero(np.diff(same))
    start, stop = turn[::2], turn[1::2] + q
    keep = stop - start >= EXPONENT * q
    return np.stack([start[keep], stop[keep], np.full(keep.sum(), q)], axis=1)


def _at_scale(text: np.ndarray, firsts: np.ndarray, closing: np.ndarray, t: int, known: np.ndarray) -> np.ndarray:
    """Runs with periods above ``t`` and up to ``2 t`` in the given texts."""
    lengths = closing - firsts + 1
    place = np.repeat(firsts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    part, owner = text[place], np.repeat(np.arange(len(firsts)), lengths)
    n = len(part)
    if n < 2 * t:
        return np.zeros((0, 3), np.int64)
    window, width = mix(part.astype(U) * U(2) + U(1)), 1
    while width < t:
        window = mix(window[:-width] * STEP + window[width:])
        width *= 2
    context = mix(window[:-t] * STEP + window[t:])  # of 2 t words
    ranked = np.where(_periodic(text, place, t, known)[: len(window)], np.iinfo(U).max, window)
    least, width = ranked, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], ranked[t:][: len(least) - 1])  # over t + 1 windows
    m = min(len(least), len(context))
    least = least[:m]
    chosen = np.flatnonzero(((least == ranked[:m]) | (least == ranked[t : t + m])) & (least != np.iinfo(U).max))
    chosen = chosen[np.argsort(context[chosen], kind="stable")]
    near = np.diff(chosen)
    pair = (context[chosen[1:]] == context[chosen[:-1]]) & (near > t) & (near <= 2 * t)
    at, q = chosen[:-1][pair], near[pair]
    proposed = np.unique(np.stack([owner[at], q], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    out = [np.zeros((0, 3), np.int64)]
    for k, period in proposed.tolist():
        runs = _direct(text[firsts[k] : closing[k]], period)
        runs[:, :2] += firsts[k]
        out.append(runs)
    return np.concatenate(out)


def _periodic(text: np.ndarray, place: np.ndarray, t: int, known: np.ndarray) -> np.ndarray:
    """Whether the ``t`` words from each place on lie in a run with a period of at most ``t / EXPONENT``."""
    runs = known[(known[:, 2] * EXPONENT <= t) & (known[:, 1] - known[:, 0] >= t)]
    marks = np.zeros(len(text) + 1, np.int32)
    np.add.at(marks, runs[:, 0], 1)
    np.add.at(marks, runs[:, 1] - t + 1, -1)
    return np.cumsum(marks)[place] > 0


def collapse(n: int, runs: np.ndarray, first: int = 0) -> np.ndarray:
    """Which of ``n`` words stay: in each run the first period does. ``runs`` count from ``first``."""
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2] - first, 1)
    np.add.at(gone, runs[:, 1] - first, -1)
    return np.cumsum(gone)[:-1] <= 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, runs, collapsed`` for every row.

    Words are maximal runs of characters other than space and the characters 9 to 13. ``runs`` lists
    start, length and period of every run by start, then period, in words from 0. ``collapsed`` is
    the text's words, joined by one space, without what repeats the first period of a run.

    Null texts, empty ones and texts of white space have no runs and collapse to nothing. Rows that
    repeat are treated each; an empty table gives an empty result. Whole texts are searched, however
    long. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            texts = part.column("_text")
            codes, ends = word_codes(texts)
            runs = find_runs(codes, ends)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            of = np.searchsorted(runs[:, 0], np.concatenate([starts, ends[-1:]]))
            collapsed = []
            for i, text in enumerate(texts.to_pylist()):
                kept = text.encode().split()
                mine = runs[of[i] : of[i + 1]]
                if len(mine):
                    stays = collapse(len(kept), mine, starts[i])
                    kept = [kept[k] for k in np.flatnonzero(stays).tolist()]
                collapsed.append(b" ".join(kept))
            base = np.repeat(starts, np.diff(of))
            fields = [pa.array(runs[:, 0] - base), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])]
            listed = pa.ListArray.from_arrays(
                pa.array(of.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]),
            )
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), listed, pa.array(collapsed, pa.binary()).cast(pa.string())], ["_id", "runs", "collapsed"],
            )

    out = with_ids(docs, id_col, text_col).mapInArrow(run, f"_id {kind}, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("_id", id_col)
