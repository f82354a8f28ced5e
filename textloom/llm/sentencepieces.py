"""SentencePiece encoding and decoding by a Viterbi pass over a trie of distinct words.

A text is its words, each behind the mark of the space before it; no piece reaches over a mark. The
distinct words of a batch are sorted, which lists a trie depth first, and each word goes on from the
states of the prefix it shares with the word before.

The vocabulary's pieces are merges with a rank. A sequence of pieces is what the merges give exactly
if every two neighbours stay apart when their joined text is merged; so the forward score of a place
is 0 for the last piece of the merged prefix and minus infinity for all others, and the state is that
piece alone. It depends on the prefix only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.arrow import slices

MARK = "▁"
CACHED_WORDS = 600_000
LONGEST_CACHED = 80


class Pieces:
    """A vocabulary of ranked merges with byte fallback, a mark before the text and no other normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(len(p) > 1 and (not set(p) <= self.ids.keys() or MARK in p.lstrip(MARK)) for p in self.ids):
            raise ValueError("a piece reaches over a mark or holds a character that is no piece")
        if model.normalize(" a") != MARK + MARK + "a":
            raise ValueError("the model normalises texts")
        self.coded = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.coded_bytes = [i.to_bytes(4, "little") for i in self.byte_ids]
        self.spelled = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()} | {
            i: bytes([b]) for b, i in enumerate(self.byte_ids)
        }
        self.real = {p for p in self.ids if self.merged(p) == [p]}  # the others no merge arrives at
        ending: dict[str, set[int]] = {}
        for p in self.real:
            if len(p) > 2:
                ending.setdefault(p[-3:], {2}).add(len(p))
        self.sizes = {c: sorted(n, reverse=True) for c, n in ending.items()}  # of the pieces that end with three characters, and 2
        self.apart: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.last: list[str] = []  # the state after each character of the word at hand
        self.word = ""

    def merged(self, text: str) -> list[str]:
        """The merges in order of score, the leftmost of equal ones first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)):
                score = self.scores.get(a + b)
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stay_apart(self, a: str, b: str) -> bool:
        free = a not in self.ids or b not in self.ids or self.merged(a + b) == [a, b]
        if len(self.apart) >= 1_000_000:
            self.apart.clear()
        self.apart[a, b] = free
        return free

    def _walk(self, word: str) -> list[str]:
        """Pieces of a word that follows the one before in sorted order."""
        shared = 0
        for a, b in zip(word, self.word, strict=False):
            if a != b:
                break
            shared += 1
        last = self.last[:shared]
        real, known, sizes = self.real, self.apart, self.sizes
        for i in range(shared, len(word)):
            state = word[i]  # a character without a piece stands alone
            for n in sizes.get(word[i - 2 : i + 1], (2,)):
                if n > i + 1:
                    continue
                piece = word[i + 1 - n : i + 1]
                if piece in real:
                    if n > i:
                        state = piece
                        break
                    pair = last[i - n], piece
                    free = known.get(pair)
                    if self._stay_apart(*pair) if free is None else free:
                        state = piece
                        break
            last.append(state)
        self.word, self.last = word, last
        out, at = [], len(word)
        while at:
            out.append(last[at - 1])
            at -= len(last[at - 1])
        return out[::-1]

    def spell(self, pieces: Iterable[str]) -> bytes:
        """Ids of pieces as little-endian unsigned 32-bit integers."""
        coded = self.coded
        return b"".join([coded[p] if p in coded else b"".join([self.coded_bytes[b] for b in p.encode()]) for p in pieces])

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of the words that are not known yet."""
        return {w: self.spell(self._walk(MARK + w)) for w in sorted(words)}

    def run(self, marks: int) -> bytes:
        return self.spell(self.merged(MARK * min(marks, 512)) if marks <= 512 else self._long_run(marks))

    def _long_run(self, marks: int) -> list[str]:
        """Runs are merged from the left in equal steps, so all but the end repeats the longest piece."""
        longest = max((p for p in self.ids if not p.strip(MARK)), key=len)
        whole = max(0, marks // len(longest) - 2)
        return [longest] * whole + self.merged(MARK * (marks - whole * len(longest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.replace(MARK, " ").split(" ") if t else [] for t in texts]
        fresh = {w for words in cut for w in words} - self.words.keys()
        fresh.discard("")
        if len(self.words) + len(fresh) > CACHED_WORDS:
            self.words.clear()
            fresh = {w for words in cut for w in words if w}
        known = self.learn(fresh)
        self.words.update((w, i) for w, i in known.items() if len(w) <= LONGEST_CACHED)
        known = self.words | known if any(len(w) > LONGEST_CACHED for w in known) else self.words
        mark, out = self.spell([MARK]), []
        for words in cut:
            if "" not in words:
                out.append(b"".join(map(known.__getitem__, words)))
                continue
            parts, marks = [], 0
            for w in words:
                marks += 1
                if w:
                    ids = known[w]
                    if ids[:4] == mark:  # a lone mark joins the run before it
                        parts += [self.run(marks), ids[4:]]
                    else:
                        parts += [self.run(marks - 1), ids]
                    marks = 0
            out.append(b"".join([*parts, self.run(marks)]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.spelled.get(i, b"") for i in ids.tolist()])
        return (text[1:] if text[:1] == b" " else text).decode(errors="replace")


@cache
def pieces(path: str) -> Pieces:
    """One vocabulary per worker process."""
    return Pieces(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_crc32, ids`` for every row; the checksum covers the ids as little-endian 32 bits.

    Null and empty texts have no ids. Rows that repeat are encoded each; an empty table gives an empty
    result. Whole texts are encoded, however long; a mark written in a text counts as a space. Other
    columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for part in slices(batches, "_text"):
            ids = vocabulary.encode(part.column("_text").to_pylist())
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_id"), pa.array(sizes), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4"))),
                ],
                ["_id", "n_tokens", "ids_crc32", "ids"],
            )

    out = slim.mapInArrow(run, f"_id {kind}, n_tokens bigint, ids_crc32 bigint, ids array<int>")
    return out.withColumnRenamed("_id", id_col)


def decode(table: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``table`` with ``text_col`` in place of ``ids_col``. Null ids give null; control ids give nothing."""
    others = [c for c in table.columns if c not in (ids_col, text_col)]
    kinds = [f"`{c}` {table.schema[c].dataType.simpleString()}" for c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for batch in batches:
            ids = batch.column(ids_col)
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy()
            texts = [
                vocabulary.decode(values[a:b]) if ok else None
                for a, b, ok in zip(ends[:-1], ends[1:], ids.is_valid().to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], [*others, text_col])

    return table.mapInArrow(run, ", ".join([*kinds, f"`{text_col}` string"]))
