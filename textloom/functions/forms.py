"""Normal forms of passages and chunks as plain functions, for steps that handle a whole chunk or batch in Python.

``strict`` and ``loose`` give what ``text.strict_form`` and ``text.loose_form`` give, at a fraction of their time.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

# Words that say nothing about the content of a quote.
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "if", "then", "than", "to", "of", "in", "on",
    "for", "with", "by", "at", "as", "is", "are", "was", "were", "be", "been", "being",
    "it", "its", "this", "that", "these", "those", "we", "you", "i", "he", "she", "they",
    "them", "his", "her", "their", "our", "us", "my", "your", "not", "no", "so", "do",
    "does", "did", "from", "into", "over", "under", "up", "down", "out", "about",
    "because", "which", "who", "whom", "what", "when", "where", "why", "how",
]
# Thresholds of the checks.
MIN_STRICT, MIN_LOOSE = 10, 18

_STOPWORDS = frozenset(STOPWORDS)
_INSERTION = re.compile(r"\[.*?\]", re.DOTALL)
_LONE_MARK = re.compile(r"(?<!\w)[\"']|[\"'](?!\w)")
_MARKS = "“”‘’\"'"
_OUTER_MARKS = re.compile(rf"\A[{_MARKS}]+|[{_MARKS}]+\Z")
_ELLIPSIS = re.compile(r"\.\.\.|…")
# In this order, as the first two make marks of pairs.
_ASCII = [("``", '"'), ("''", '"'), ("`", "'"), ("\\n", " "), ("-", " ")]
_OTHERS = [("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("…", "..."), ("–", " "), ("—", " ")]
# Bytes that loose forms keep. 0xFF, which no text holds, parts the texts of a batch.
LOOSE_BYTES = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b == 255 else 32 for b in range(256))


def decomposed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKD", text)


def strict(raw: str) -> str:
    """Strict form of decomposed text. White space is split at, so line ends need no step of their own."""
    s = raw
    for a, b in _ASCII if s.isascii() else _ASCII[:2] + _OTHERS + _ASCII[2:]:
        s = s.replace(a, b)
    if "[" in s:
        s = _INSERTION.sub("", s)
    s = " ".join(s.split()).lower()
    return _LONE_MARK.sub("", s) if "'" in s or '"' in s else s


def loose(strict_form: str) -> str:
    return b" ".join(strict_form.encode().translate(LOOSE_BYTES).split()).decode()


def pieces(raw: str) -> list[str]:
    """Decomposed passage without surrounding quote marks, split at ellipses, without empty pieces."""
    bare = raw.strip()
    if bare and (bare[0] in _MARKS or bare[-1] in _MARKS):
        bare = _OUTER_MARKS.sub("", bare).strip()
    if "..." not in bare and "…" not in bare:
        return [bare] if bare else []
    return [p for p in _ELLIPSIS.split(bare) if p]


def content_words(loose_form: str) -> list[str]:
    """Distinct words of three or more characters that are not stopwords."""
    return [w for w in dict.fromkeys(loose_form.split(" ")) if len(w) >= 3 and w not in _STOPWORDS]


class QuoteForms(NamedTuple):
    q_strict: str
    q_loose: str
    s_strict: list[str]
    s_loose: list[str]

    def words(self) -> list[str]:
        """Content words of the passage."""
        return content_words(" ".join(self.s_loose) if self.s_loose else self.q_loose)


def quote_forms(passage: str | None) -> QuoteForms:
    """Normal forms of a passage and of its segments between ellipses.

    A passage of one piece, which most are, is its only segment, whatever its length, so one normal form serves
    for all of them.
    """
    raw = decomposed(passage or "")
    parts = pieces(raw)
    q_strict = strict(raw)
    q_loose = loose(q_strict)
    if len(parts) > 1:
        each = [strict(p) for p in parts]
        whole = strict(" ".join(parts))
        s_strict = [s for s in each if len(s) >= MIN_STRICT] or [s for s in [whole] if s]
        s_loose = [s for s in map(loose, each) if len(s) >= MIN_LOOSE] or [s for s in [loose(whole)] if s]
        return QuoteForms(q_strict, q_loose, s_strict, s_loose)
    piece = parts[0] if parts else ""
    one = q_strict if piece == raw else strict(piece)
    one_loose = q_loose if one == q_strict else loose(one)
    return QuoteForms(q_strict, q_loose, [one] if one else [], [one_loose] if one_loose else [])


def in_order(body: str, segments: list[str]) -> bool:
    """True if every segment is found at or after the end of the one before."""
    at = 0
    for s in segments:
        at = body.find(s, at)
        if at < 0:
            return False
        at += len(s)
    return bool(segments) and bool(body)


def least_windows(quote: str, shortest: int, word_start: bool = False, share: float = 0.0) -> list[str]:
    """The shortest of the windows of ``quotes.windows``. A text with any of the windows holds one of these, as every
    longer window begins with the shortest one at its place."""
    n = len(quote)
    sizes = [w for w in range(min(n, 60), shortest - 1, -10) if not share or w / n >= share]
    if not sizes:
        return []
    w = sizes[-1]
    return [quote[s:s + w] for s in range(0, n - w + 1, 10) if not word_start or s == 0 or quote[s - 1] == " "]


class Chunk:
    """A strict form with its loose form and words, made when first asked for."""

    __slots__ = ("strict", "_loose", "_words")

    def __init__(self, strict_form: str | None):
        self.strict, self._loose, self._words = strict_form or "", None, None

    @property
    def loose(self) -> str:
        if self._loose is None:
            self._loose = loose(self.strict)
        return self._loose

    @property
    def words(self) -> set[str]:
        if self._words is None:
            self._words = set(self.loose.split(" "))
        return self._words
