"""Token counts by prefix dynamic programming: the exact count at every prefix of a text.

The vocabulary's pieces are merges with a score. A sequence of pieces is what merging gives exactly if
every two neighbours stay apart when their joined text is merged alone. Merging a prefix therefore
ends with one certain piece: the one that stays apart from the last piece of what lies before it. So

    count(prefix) = count(prefix without its last piece) + 1,

and one pass over a text gives the count at every prefix. A count can fall from one prefix to the
next, as a longer piece may take the place of several.

No piece reaches over the mark of a space, nor over a character that no piece holds, so a text is cut
there, and equal units of a slice are counted once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.arrow import slices, text_ends
from textloom.llm.common import with_ids

MARK = "▁"
BREAK = "\n"
UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CACHE_BYTES = 96 * 1024 * 1024
ENTRY_BYTES = 150  # of a cached unit beside its characters
LONGEST_CACHED = 80
APART_ENTRIES = 1_000_000
Step = tuple[int, tuple[tuple[int, int, dict[int, bool]], ...]]


class PrefixCounter:
    """Counts for a vocabulary of ranked merges with byte fallback and a mark before the text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" a") != MARK + MARK + "a":
            raise ValueError("the model normalises texts")
        plain = [
            i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.letters = {p for p in self.scores if len(p) == 1}
        if any(len(p) > 1 and (not set(p) <= self.letters or MARK in p.lstrip(MARK)) for p in self.scores):
            raise ValueError("a piece reaches over a mark or holds a character that is no piece")
        self.breaks = BREAK not in self.letters
        self.pieces = [p for p in self.scores if self.merged(p) == [p]]  # the others no merge arrives at
        self.number = {p: i for i, p in enumerate(self.pieces)}
        self.heads = sorted({p[:n] for p in self.pieces for n in range(len(p) + 1)})
        self.head_number = {h: i for i, h in enumerate(self.heads)}
        self.steps: list[dict[str, Step]] = [{} for _ in self.heads]
        self.apart: list[dict[int, bool]] = [{} for _ in self.pieces]
        self.known = 0
        self.pairs = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        self.alone = dict.fromkeys(self.letters, 1)
        self.totals: dict[str, int] = {}
        self.held = 0
        self.unit, self.count_at, self.last_at, self.state_at = "", [0], [-1], [0]  # of the unit at hand, by prefix

    def merged(self, text: str) -> list[str]:
        """The merges in order of score, the leftmost of equal ones first."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _step(self, state: int, letter: str) -> Step:
        """The longest end of ``state + letter`` that some piece begins with, and the pieces it ends with, longest first."""
        if letter not in self.letters:
            return 0, ()
        found = self.heads[state] + letter
        while found and found not in self.head_number:
            found = found[1:]
        ends = [found[i:] for i in range(len(found))]
        step = self.head_number[found], tuple((len(p), self.number[p], self.apart[self.number[p]]) for p in ends if p in self.number)
        self.steps[state][letter] = step
        return step

    def _stays_apart(self, a: int, b: int) -> bool:
        first, second = self.pieces[a], self.pieces[b]
        free = self.merged(first + second) == [first, second]
        self.known += 1
        if self.known > APART_ENTRIES:
            self.known = 1
            for row in self.apart:
                row.clear()
        self.apart[b][a] = free
        return free

    def prefixes(self, unit: str) -> list[int]:
        """The number of tokens of every prefix of a unit, the empty one first.

        What the unit shares with the one before is not computed again. The list is valid until the next call.
        """
        counts, last, states, before_unit = self.count_at, self.last_at, self.state_at, self.unit
        shared = 0
        for a, b in zip(unit, before_unit):  # noqa: B905
            if a != b:
                break
            shared += 1
        del counts[shared + 1 :], last[shared + 1 :], states[shared + 1 :]
        self.unit = unit
        state, steps = states[shared], self.steps
        for i in range(shared, len(unit)):
            letter = unit[i]
            state, ends = steps[state].get(letter) or self._step(state, letter)
            states.append(state)
            for size, piece, apart in ends:
                before = last[i + 1 - size]
                if before < 0:  # the unit begins, or a character without a piece, which nothing merges with
                    break
                free = apart.get(before)
                if self._stays_apart(before, piece) if free is None else free:
                    break
            else:
                last.append(-1)
                counts.append(counts[i] + len(letter.encode(errors="replace")))
                continue
            last.append(piece)
            counts.append(counts[i + 1 - size] + 1)
        return counts

    def _total(self, unit: str) -> int:
        """Tokens of a unit as a slice names it: a mark stands before it unless it begins with a break."""
        return self.prefixes(unit if self.breaks and unit[:1] == BREAK else MARK + unit)[-1]

    def totals_for(self, units: list[str]) -> list[int]:
        """The number of tokens of each unit. Last characters that no piece joins to the one before are counted apart."""
        totals, pairs, alone = self.totals, self.pairs, self.alone
        cores, extra = list(units), [0] * len(units)
        fresh = set()
        for k, unit in enumerate(units):
            if unit in totals:
                continue
            end = len(unit)
            while end > 1 and unit[end - 2 : end] not in pairs:
                tail = unit[end - 1]
                more = alone.get(tail)
                extra[k] += len(tail.encode(errors="replace")) if more is None else more
                end -= 1
            core = cores[k] = unit[:end]
            if core not in totals:
                fresh.add(core)
        own = {u: self._total(u) for u in sorted(fresh)}
        out = [(totals.get(c) if c in totals else own[c]) + e if c else 0 for c, e in zip(cores, extra, strict=True)]
        for unit, n in own.items():
            if len(unit) <= LONGEST_CACHED:
                self.held += ENTRY_BYTES + len(unit)
                totals[unit] = n
        if self.held > CACHE_BYTES:
            totals.clear()
            self.held = 0
        return out

    def counts(self, text: str) -> list[int]:
        """``counts[i]`` is the number of tokens of ``text[:i]``."""
        out = [0]
        for unit in UNITS.findall(MARK + text.replace(" ", MARK)):
            base = out[-1]
            out += [base + n for n in self.prefixes(unit)[1:]]
        return [0, *out[2:]]  # the mark before the text is no character of it

    def totals_of(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of every text. Nulls are not allowed."""
        texts = pc.replace_substring(texts, MARK, " ")
        cut = pc.replace_substring(texts, BREAK, " " + BREAK) if self.breaks else texts
        units = pc.split_pattern(cut, " ")
        words = units.flatten().dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        per_name = np.array(self.totals_for(names), np.int64)
        codes = words.indices.to_numpy()
        sums = np.concatenate([[0], np.cumsum(per_name[codes])])
        ends = np.concatenate([[0], np.cumsum(units.value_lengths().to_numpy())]).astype(np.int64)
        out = sums[ends[1:]] - sums[ends[:-1]]
        if "" in names:  # neighbouring spaces merge with each other
            empty = np.concatenate([[0], np.cumsum(codes == names.index(""))])
            for i in np.flatnonzero(empty[ends[1:]] > empty[ends[:-1]]).tolist():
                text = texts[i].as_py()
                out[i] = sum(self.prefixes(u)[-1] for u in UNITS.findall(MARK + text.replace(" ", MARK))) if text else 0
        return out


@cache
def counter(path: str) -> PrefixCounter:
    """One counter per worker process."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens`` for every row: the count at the last prefix of the whole text.

    Null and empty texts have 0 bytes and 0 tokens. Rows that repeat are counted each; an empty table
    gives an empty result. A mark written in a text counts as a space, as the library takes it. Other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for part in slices(batches, "_text"):
            texts = part.column("_text")
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), pa.array(np.diff(text_ends(texts))), pa.array(own.totals_of(texts))],
                ["_id", "n_bytes", "n_tokens"],
            )

    out = with_ids(docs, id_col, text_col).mapInArrow(run, f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumnRenamed("_id", id_col)


def prefix_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, counts`` for every row; ``counts[i]`` is the number of tokens of the first ``i`` characters.

    An array holds one number more than its text has code points; null and empty texts have ``[0]``.
    Written with ``store_prefixes``, differences of neighbouring counts take a few bits each.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for part in slices(batches, "_text", 1024 * 1024):
            found = [own.counts(t) for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(found, pa.list_(pa.int32()))], ["_id", "counts"])

    out = with_ids(docs, id_col, text_col).mapInArrow(run, f"_id {kind}, counts array<int>")
    return out.withColumnRenamed("_id", id_col)


def store_prefixes(docs: DataFrame, path: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``prefix_counts`` as Parquet with delta encoding, so that later questions read no text."""
    found = prefix_counts(docs, model, id_col, text_col)
    found.write.options(**{"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}).parquet(path)


def tokens_before(counts: Column, characters: Column) -> Column:
    """The number of tokens of the first ``characters`` code points; of the whole text if it has fewer."""
    return F.get(counts, F.least(characters, F.size(counts) - 1))


def longest_within(counts: Column, budget: Column | int) -> Column:
    """The length in code points of the longest prefix of at most ``budget`` tokens; null for a negative budget.

    Counts may fall, so longer prefixes than the first that fits no more are considered too.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.transform(counts, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fits)
