"""Spelling variants: words of a corpus one edit apart, by a bit-sliced index over positions and letters.

For every position and letter a bitset over the vocabulary tells which words have it there. A word is
compared with 64 others at a time: going through its letters, one set holds the words that agree so
far, one those that differ by one replaced letter, one those with one more letter, read a position on.

The vocabulary is cut so that no index grows with it. If two words are one edit apart and the shorter
has ``l`` letters, the edit lies before or after the middle, and the other half agrees. Words meet in
*frames*: an ``l``, the part of the word that the edit may change, and the letters around it as key. A
frame of more than ``FRAME_WORDS`` words is cut in the middle again, so that more letters join the
key. The first place where two words differ lies in one frame alone, hence each pair is found once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.arrow import slices
from textloom.llm.common import store, with_ids

FRAME_WORDS = 4096
BLOCK_WORDS = 512
HELD_WORDS = 300_000
TASK_ROWS = 250_000


def vocabulary(
    docs: DataFrame, letters: str, shortest: int, rarest: int, change: Callable[[object, str], str] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``word, n``: words of ``shortest`` letters or more that occur ``rarest`` times or more in all texts.

    Words are maximal runs of ``letters``, the inside of a character class, with A-Z lowered.
    ``change(id, word)`` may replace an occurrence before it is counted. Null texts have no words;
    rows that repeat count each; an empty table gives an empty result. Other columns are not read.
    A task sends each word it met once for every ``HELD_WORDS`` distinct ones it holds.
    """
    pattern = re.compile(f"[{letters}]+")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for part in slices(batches, "_text"):
            for doc, text in zip(part.column("_id").to_pylist(), part.column("_text").to_pylist(), strict=True):
                low = text.encode().lower().decode()  # bytes lower A-Z alone
                for word, n in Counter(pattern.findall(low)).items():
                    if len(word) < shortest:
                        continue
                    kept = change(doc, word) if change else word
                    if len(kept) >= shortest:
                        held[kept] += n
            if len(held) >= HELD_WORDS:
                yield _counts(held)
                held.clear()
        yield _counts(held)

    found = with_ids(docs, id_col, text_col).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest)


def _counts(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"],
    )


def _frame(short: Column, lo: Column, hi: Column) -> Column:
    """The part from ``lo`` to ``hi`` of a word with ``short`` letters, or one letter more, may hold the edit."""
    size, after = F.length("word"), short - hi
    around = F.concat_ws(
        " ", short, lo, hi, F.substring(F.col("word"), F.lit(1), lo), F.substring(F.col("word"), size - after + 1, after),
    )
    return F.struct(
        short.alias("short"), lo.alias("lo"), hi.alias("hi"), (hi == short).alias("to_end"), around.alias("key"),
        F.substring(F.col("word"), lo + 1, size - after - lo).alias("part"),
    )


def _halves(short: Column, lo: Column, hi: Column) -> list[Column]:
    middle = lo + F.floor((hi - lo) / 2).cast("int")
    return [_frame(short, lo, middle), _frame(short, middle, hi)]


def _opened(rows: DataFrame, frames: list[Column]) -> DataFrame:
    """One row per frame. A frame without letters holds an edit only if it reaches the end."""
    out = rows.select("word", "n", F.explode(F.array(*frames)).alias("_f")).select("word", "n", "_f.*")
    return out.filter("hi > lo or to_end")


def near_words(words: DataFrame, frame_words: int = FRAME_WORDS) -> DataFrame:
    """``word, n_near, best_n, best``: how many words of ``words`` (``word, n``) are one edit apart, and the most frequent.

    An edit inserts, deletes or replaces one letter. Of equally frequent words the first in
    code-point order is the best. Words without a near word have no row. ``word`` must not repeat.
    """
    size = F.length("word")
    zero = F.lit(0)
    frames = _opened(words, [f for short in (size, size - 1) for f in _halves(short, zero, short)])
    found: list[DataFrame] = []
    while True:
        crowd = frames.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("hi") - F.col("lo")).alias("_w"))
        crowd = store(crowd.filter((F.col("_n") > frame_words) & (F.col("_w") > 1)).select("key"), "frames")
        more = not crowd.isEmpty()
        found.append(_matched(frames.join(crowd, "key", "left_anti") if more else frames))
        if not more:
            break
        frames = frames.join(crowd, "key", "left_semi")
        frames = store(_opened(frames, _halves(F.col("short"), F.col("lo"), F.col("hi"))), "frames")
    pairs = found[0]
    for each in found[1:]:
        pairs = pairs.unionByName(each)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select(
        "word", "n_near", (-F.col("_b.less")).alias("best_n"), F.col("_b.best").alias("best"),
    )


def _matched(frames: DataFrame) -> DataFrame:
    """Each frame's pairs, summed up by word: ``word, n_near, best_n, best``."""
    rows = frames.select("key", (F.col("hi") - F.col("lo")).alias("width"), "to_end", "part", "word", "n")
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    rows = rows.repartition(tasks, "key").sortWithinPartitions("width", "to_end", "key")
    return rows.mapInArrow(_match, "word string, n_near bigint, best_n bigint, best string")


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole frames of one width, about ``BLOCK_WORDS`` words at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < 16 * BLOCK_WORDS:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        cuts = _cuts(table)
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):  # the last frame may go on
            yield _block(table.slice(a, b - a))
        held = [table.slice(cuts[-2])]
    if held:
        rest = pa.Table.from_batches(held).combine_chunks().to_batches()
        for table in rest:
            cuts = _cuts(table)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield _block(table.slice(a, b - a))


def _cuts(table: pa.RecordBatch) -> list[int]:
    """Where blocks begin, and the end. The last block holds one frame alone."""
    key = table.column("key").dictionary_encode().indices.to_numpy()
    kind = table.column("width").to_numpy() * 2 + table.column("to_end").to_numpy(zero_copy_only=False)
    new = np.flatnonzero(np.diff(key)) + 1
    cuts = [0]
    for at in new.tolist():
        if at - cuts[-1] >= BLOCK_WORDS or kind[at] != kind[at - 1]:
            cuts.append(at)
    if len(new) and cuts[-1] != new[-1]:
        cuts.append(int(new[-1]))
    return [*cuts, table.num_rows]


def _bits(rows: np.ndarray) -> np.ndarray:
    """Rows of booleans as bitsets of 64-bit integers."""
    packed = np.packbits(rows, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def _block(table: pa.RecordBatch) -> pa.RecordBatch:
    """The pairs of some frames of one width. Each word with ``width`` letters in its part asks all."""
    width, to_end = table.column("width")[0].as_py(), table.column("to_end")[0].as_py()
    parts = table.column("part").to_pylist()
    group = table.column("key").dictionary_encode().indices.to_numpy()
    count = len(parts)
    sizes = np.array([len(p) for p in parts])
    padded = "".join([p.ljust(width + 1, "\0") for p in parts])
    _, letters = np.unique(np.frombuffer(padded.encode("utf-32-le"), np.uint32), return_inverse=True)
    letters = letters.reshape(count, width + 1)
    longer = _bits((sizes == width + 1)[None, :])
    asking = np.flatnonzero(sizes == width)
    sources, targets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(asking):
        index = [_bits(letters[:, r] == np.arange(letters.max() + 1)[:, None]) for r in range(width + 1)]
        own = _bits(group == np.arange(group.max() + 1)[:, None])
        for at in range(0, len(asking), BLOCK_WORDS):
            some = asking[at : at + BLOCK_WORDS]
            agree = own[group[some]]
            replaced, added = np.zeros_like(agree), np.zeros_like(agree)
            for r in range(width):
                here, next_ = index[r][letters[some, r]], index[r + 1][letters[some, r]]
                apart = agree & ~here
                replaced = (replaced & here) | (apart & ~longer)
                added = (added | (apart & longer)) & next_
                agree = agree & here
            if to_end:
                added |= agree & longer
            for hits, both in ((replaced, False), (added, True)):
                bits = np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little")
                which, target = np.nonzero(bits)
                source = some[which]
                sources += [source, target] if both else [source]
                targets += [target, source] if both else [target]
    source, target = np.concatenate(sources), np.concatenate(targets)
    words, n = table.column("word"), table.column("n").to_numpy()
    by_word = np.empty(count, np.int64)
    by_word[np.array(pa.compute.sort_indices(words))] = np.arange(count)
    rank = np.empty(count, np.int64)
    rank[np.lexsort((by_word, -n))] = np.arange(count)
    order = np.lexsort((rank[target], source))
    source, target = source[order], target[order]
    first = np.flatnonzero(np.diff(source, prepend=-1))
    best = target[first]
    return pa.RecordBatch.from_arrays(
        [
            words.take(pa.array(source[first])), pa.array(np.diff(np.append(first, len(source)))), pa.array(n[best]),
            words.take(pa.array(best)),
        ],
        ["word", "n_near", "best_n", "best"],
    )


def variants(words: DataFrame, factor: int = 10, frame_words: int = FRAME_WORDS) -> DataFrame:
    """``word, n, n_near, form_n, form, root`` for every row of ``words`` (``word, n``; ``word`` must not repeat).

    The form of a word is its most frequent near word, if that occurs ``factor`` times as often or
    more, else null; ties go to the first in code-point order. The root is the end of the chain of
    forms, for a word without a form the word itself. ``factor`` must be at least 2: frequencies then
    grow along a chain, which has no circle and at most log(n) steps, and the joins that follow
    chains double their reach each time. An empty table gives an empty result.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    near = near_words(words, frame_words)
    has = F.col("best_n") >= factor * F.col("n")
    known = store(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, F.col("best_n")).alias("form_n"), F.when(has, F.col("best")).alias("form"),
        ),
        "forms",
    )
    most = known.agg(F.max("n")).first()[0] or 1
    steps, reach = 0, factor
    while reach <= most:  # the longest chain that frequencies allow
        steps, reach = steps + 1, reach * factor
    chains = known.filter("form is not null").select("word", F.col("form").alias("root"))
    covered = 1
    while covered < steps:
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        chains = store(chains.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "chains")
        covered *= 2
    return known.join(chains, "word", "left").withColumn("root", F.coalesce("root", "word"))
