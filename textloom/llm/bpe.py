"""Byte-pair encoding of whole texts with the tokenizers library, each distinct word once.

Both public vocabularies encode a text piece by piece, so equal pieces have equal ids. The texts of a
slice are cut at single spaces and line ends, and words from a mark that closes them. A table of the
ids of known words lies in flat arrays, about thirty bytes a word, sorted by a 64-bit hash of the
word; two words of one length would have to share it to be confused. The library's model encodes the
pieces of new words, many in one call; all else is done on whole arrays.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa

from textloom.llm.hashing import U, buffers, mix, prefix_hashes, words

SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
MOST_KNOWN = 1_500_000
ENCODED_BYTES = 2 * 1024 * 1024  # of text at once: the arrays beside it take about twenty times as much
CALL_PIECES = 8_000
SPACE, LINE = 32, 10
CLOSING = ",.;:!?"
SPLIT_WHEN_LOW = "İ"  # the one such letter that is lowered to a letter and a mark
PLAIN = "ɐ"  # below this character all Unicode versions agree on letters and digits
FLAG = U(0xA0761D6478BD642F)
BETWEEN = np.zeros(256, bool)
BETWEEN[[SPACE, LINE]] = True
IS_CLOSING = np.zeros(256, np.int8)
IS_CLOSING[[ord(c) for c in CLOSING]] = np.arange(1, len(CLOSING) + 1)
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
IS_TAIL = np.zeros(256, bool)  # second bytes of the letters from À to ÿ
IS_TAIL[128:192] = True
IS_TAIL[[0x97, 0xB7]] = False

# The published pattern of the byte-level vocabulary.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_names() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + hidden.index(b)) for b in hidden}


class Encoder:
    """Ids of texts as unsigned 32-bit integers, without special tokens. The table forgets all beyond ``most_known`` words."""

    def __init__(self, path: str, most_known: int = MOST_KNOWN):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokenizer = Tokenizer.from_file(path)
        self.cutter, self.normaliser = tokenizer.pre_tokenizer, tokenizer.normalizer
        self.model = Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # a piece holds no white space: its bytes have other names
        self.words = spec["pre_tokenizer"]["type"] == "Sequence"  # white space is dropped, letters are lowered
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if self.words else BYTE_PATTERN
        self.find = regex.compile(pattern).findall
        self.names = _byte_names()
        self.most_known = most_known
        self.fixed = self._spelled([self._cut(c) for c in (*CLOSING, "\n")])
        self._forget()

    def _forget(self) -> None:
        """Empty the table but for the marks and the line end, which are its first entries."""
        self.ids = np.frombuffer(b"".join(self.fixed), "<u4")
        self.size = np.array([len(x) // 4 for x in self.fixed], np.int32)
        self.begin = np.cumsum(self.size, dtype=np.int64) - self.size
        self.crosses = np.zeros(len(self.fixed), bool)  # words that begin or end with other white space
        self.length = np.zeros(len(self.fixed), np.int32)
        self.hashes, self.entries = np.zeros(0, U), np.zeros(0, np.int32)

    def encode(self, text: str) -> bytes:
        """The ids of one text, little-endian."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def encode_all(self, texts: pa.Array, closing: Iterable[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by the ids of ``closing``, and where each text ends."""
        data, ends = buffers(texts)
        starts, stops = words(data, ends, BETWEEN)
        of = np.searchsorted(starts, ends)  # words before each text
        kept_stops, marks = self._without_marks(data, starts, stops)
        spaced, lined = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
        if not self.words and len(starts):
            inner = np.ones(len(starts) + 1, bool)
            inner[of[:-1]] = False
            before = data[np.maximum(starts, 1) - 1]
            spaced, lined = (before == SPACE) & inner[:-1], (before == LINE) & inner[:-1]
        entry = self._entries(data, starts, kept_stops, spaced)
        units = 1 + (marks > 0) + lined
        place = np.cumsum(units) - units
        codes = np.empty(int(units.sum()), np.int64)
        codes[place[lined]] = len(CLOSING)
        codes[place + lined] = entry
        codes[(place + lined + 1)[marks > 0]] = marks[marks > 0] - 1
        bounds = np.concatenate([place, [len(codes)]])[of]
        extra, odd = [array("I", closing).tobytes()], np.zeros(len(texts), bool)
        if not self.words:  # runs of white space cross words: such texts are cut at single spaces only
            between = np.concatenate([[0], np.cumsum(BETWEEN[data])])[ends]
            crossed = np.concatenate([[0], np.cumsum(self.crosses[entry])])[of]
            odd = (np.diff(between) > np.maximum(np.diff(of) - 1, 0)) | (np.diff(crossed) > 0)
            extra += self._spelled([self._across(texts[i].as_py()) for i in np.flatnonzero(odd).tolist()])
            kept = np.repeat(~odd, np.diff(bounds))
            codes, bounds = codes[kept], np.concatenate([[0], np.cumsum(kept)])[bounds]
        stop = len(self.size) + np.stack([np.cumsum(odd), np.zeros(len(texts), np.int64)], axis=1)
        needed = np.stack([odd, np.ones(len(texts), bool)], axis=1)  # the ids of an odd text, then those that close a text
        codes = np.insert(codes, np.repeat(bounds[1:], 1 + odd), stop[needed])
        bounds = bounds + np.concatenate([[0], np.cumsum(1 + odd)])
        sizes = np.concatenate([self.size, [len(x) // 4 for x in extra]])
        begins = np.concatenate([self.begin, len(self.ids) + np.cumsum([0, *(len(x) // 4 for x in extra[:-1])])])
        flat = np.concatenate([self.ids, np.frombuffer(b"".join(extra), "<u4")])
        size = sizes[codes]
        before = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(begins[codes] - before[:-1], size)
        at += np.arange(len(at))
        return flat[at], before[bounds[1:]]

    def _without_marks(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words end without a mark that closes them, and the number of that mark, 0 for none. A letter stands before it."""
        if not len(starts):
            return stops, np.zeros(0, np.int8)
        size, letter = stops - starts, data[np.maximum(stops, 2) - 2]
        wide = (size >= 3) & (data[np.maximum(stops, 3) - 3] == 0xC3) & IS_TAIL[letter]
        marks = np.where((size >= 2) & (IS_LETTER[letter] | wide), IS_CLOSING[data[stops - 1]], 0)
        return stops - (marks > 0), marks

    def _entries(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, spaced: np.ndarray) -> np.ndarray:
        """The place in the table of each word; new words are learnt. ``spaced`` words have a space before them."""
        if len(self.size) > self.most_known or len(self.ids) > 8 * self.most_known:
            self._forget()
        h = mix(prefix_hashes(data, starts, stops, (), lower=False)[0] ^ (FLAG * spaced))
        coded = pa.array(h).dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(h))[::-1]
        length = stops[first] - starts[first]
        place = np.searchsorted(self.hashes, distinct)
        found = np.full(len(distinct), -1, np.int64)
        inside = np.flatnonzero(place < len(self.hashes))
        inside = inside[self.hashes[place[inside]] == distinct[inside]]
        at = self.entries[place[inside]]
        inside, at = inside[same := self.length[at] == length[inside]], at[same]
        found[inside] = at
        new = np.flatnonzero(found < 0)
        if len(new):
            a, b = starts[first[new]].tolist(), stops[first[new]].tolist()
            chunks = [data[i:j].tobytes().decode() for i, j in zip(a, b, strict=True)]
            behind = [True] * len(new) if self.words else spaced[first[new]].tolist()
            ids = self._spelled([self._pieces(c) if s else self._cut(c) for c, s in zip(chunks, behind, strict=True)])
            size = np.array([len(x) // 4 for x in ids], np.int32)
            found[new] = len(self.size) + np.arange(len(new))
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size, dtype=np.int64) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
            self.crosses = np.concatenate([self.crosses, [c[0].isspace() or c[-1].isspace() for c in chunks]])
            self.length = np.concatenate([self.length, length[new].astype(np.int32)])
            order = np.argsort(distinct[new])
            added = distinct[new][order]
            where = np.searchsorted(self.hashes, added)
            self.hashes = np.insert(self.hashes, where, added)
            self.entries = np.insert(self.entries, where, found[new][order])
        return found[code]

    def _across(self, text: str) -> list[str]:
        """The pieces of a text with runs of white space: cut only at a space between two other characters."""
        first, *rest = SINGLE_SPACE.split(text)
        return [p for part in (first, *(" " + x for x in rest)) for p in self._cut(part)]

    def _pieces(self, chunk: str) -> list[str]:
        """The pieces of a chunk behind a space. A run of letters is one, a mark after a plain letter another."""
        if chunk[-1:] in CLOSING and chunk[-2:-1].isalpha() and chunk[-2] < PLAIN and chunk[-2] != SPLIT_WHEN_LOW:
            return [*self._pieces(chunk[:-1]), chunk[-1]]
        if chunk.isalpha() and (chunk.isascii() or max(chunk) < PLAIN):
            if not self.words:
                return [self.names[32] + self._named(chunk)]
            low = chunk.lower() if chunk.isascii() else self.normaliser.normalize_str(chunk)
            if low.isalpha():  # lowering one letter may add a mark
                return [self._named(low)]
        return self._cut(chunk if self.words else " " + chunk)

    def _named(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.names)

    def _cut(self, chunk: str) -> list[str]:
        if not chunk:
            return []
        ascii_ = chunk.isascii()
        if self.words:
            chunk = chunk.lower() if ascii_ else self.normaliser.normalize_str(chunk)
        if ascii_ or max(chunk) < PLAIN:
            return [self._named(x) for x in self.find(chunk)]
        return [x for x, _ in self.cutter.pre_tokenize_str(chunk)]

    def _spelled(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of each list of pieces; the model is asked once for each distinct piece."""
        fresh = list({p: None for pieces in lists for p in pieces})
        own: dict[str, bytes] = {}
        for at in range(0, len(fresh), CALL_PIECES):
            some = fresh[at : at + CALL_PIECES]
            found = self.model.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            stops = 4 * np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))
            start = 0
            for piece, stop in zip(some, stops.tolist(), strict=True):
                own[piece] = ids[start:stop]
                start = stop
        return [b"".join([own[p] for p in pieces]) for pieces in lists]


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)
