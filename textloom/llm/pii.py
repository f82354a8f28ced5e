"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF for what they miss."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.arrow import slices
from textloom.llm.common import bounded_sample, with_ids

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end (code points), index of the kind

# ---- patterns ------------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from every other, so only first digits are tried.
ADDRESS = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield start, done, 0
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by start and then kind."""
    found = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in ADDRESS.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split(".")):
                found.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


# ---- the tagger ----------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
CLASSES = 48
HIDDEN = 16
WIDTH, STRIDE = 96, 48
CONTEXT = 24
MOST_DOCUMENTS, LONGEST = 1500, 32 * 1024  # bounds of the fitting sample: texts, and bytes of each
MOST_WINDOWS = 1600
STEPS, BATCH, RATE = 260, 64, 0.02
LEAST_MARGIN = 0.8
SHORTEST = 7
BLOCK = 8192  # longer stretches are decoded in blocks of this, each with WIDTH characters on both sides

_CODES = np.zeros(128, np.int64)  # 0: any other character
for _group, _chars in enumerate(("bcdfghjklmnpqrstvwxyz", "aeiou", "BCDFGHJKLMNPQRSTVWXYZ", "AEIOU", "12345678"), start=1):
    _CODES[[ord(c) for c in _chars]] = _group
_CODES[[ord(c) for c in "09 \n\t.,:;@+-_%()/\\=\"'#<>[]{}!?*&"]] = np.arange(6, 38)
PAD = 40
TRIGGER = re.compile(r"[0-9@]")


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(points < 128, _CODES[np.minimum(points, 127)], 38 + (points % 2)).astype(np.int64)


@dataclass
class Tagger:
    """Parameters by name: embedding ``E``; per direction ``Wf``, ``Uf``, ``bf`` and ``Wb``, ``Ub``, ``bb``;
    emissions ``V``, ``c``; transitions ``T``."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 7) -> Tagger:
        r = np.random.default_rng(seed)
        e, h = 10, HIDDEN
        p = {"E": r.normal(0, 0.3, (CLASSES, e)), "V": r.normal(0, 0.2, (2 * h, TAGS)), "c": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS))}
        for d in "fb":
            p |= {f"W{d}": r.normal(0, 0.25, (e, 4 * h)), f"U{d}": r.normal(0, 0.2, (h, 4 * h)), f"b{d}": np.zeros(4 * h)}
            p[f"b{d}"][h : 2 * h] = 1.0  # forget gates start open
        return cls(p)

    def _lstm(self, x: np.ndarray, d: str):
        """States of one direction over ``x`` (batch, time, features), and what the gradient needs."""
        n, t, _ = x.shape
        h, c, saved = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), []
        out = np.empty((n, t, HIDDEN))
        pre = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[:, k] + h @ self.p[f"U{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = np.split(gates, 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            saved.append((k, i, f, o, g, c, h))
            c = f * c + i * g
            h = o * np.tanh(c)
            out[:, k] = h
        return out, saved

    def _lstm_gradient(self, x: np.ndarray, d: str, saved, dout: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
        dpre = np.empty((*x.shape[:2], 4 * HIDDEN))
        for k, i, f, o, g, c, h in reversed(saved):
            tc = np.tanh(f * c + i * g)
            dh = dh + dout[:, k]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            grads[f"U{d}"] += h.T @ dz
            dpre[:, k] = dz
            dh, dc = dz @ self.p[f"U{d}"].T, dc * f
        grads[f"W{d}"] += np.einsum("nte,ntz->ez", x, dpre)
        grads[f"b{d}"] += dpre.sum((0, 1))
        return dpre @ self.p[f"W{d}"].T

    def emissions(self, x: np.ndarray):
        embedded = self.p["E"][x]
        forward, sf = self._lstm(embedded, "f")
        backward, sb = self._lstm(embedded, "b")
        both = np.concatenate([forward, backward], 2)
        return both @ self.p["V"] + self.p["c"], (embedded, sf, sb, both)

    def _messages(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log messages and the log partition of each window."""
        n, t, _ = e.shape
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for k in range(1, t):
            a[:, k] = _logsum(a[:, k - 1][:, :, None] + self.p["T"], 1) + e[:, k]
        for k in range(t - 2, -1, -1):
            b[:, k] = _logsum(self.p["T"] + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2)
        return a, b, _logsum(a[:, -1], 1)

    def marginals(self, e: np.ndarray) -> np.ndarray:
        a, b, z = self._messages(e)
        return np.exp(a + b - z[:, None, None])

    def best_path(self, e: np.ndarray) -> np.ndarray:
        """The tags of highest score for each row of emissions (batch, time, tags)."""
        n, t, _ = e.shape
        rows, arrive = np.arange(n), self.p["T"].T
        back, score = np.empty((n, t, TAGS), np.uint8), e[:, 0]
        for k in range(1, t):
            options = score[:, None, :] + arrive
            back[:, k] = options.argmax(2)
            score = options.max(2) + e[:, k]
        path = np.empty((n, t), np.int64)
        path[:, -1] = score.argmax(1)
        for k in range(t - 1, 0, -1):
            path[:, k - 1] = back[rows, k, path[:, k]]
        return path

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags ``y`` and its gradient."""
        e, (embedded, sf, sb, both) = self.emissions(x)
        a, b, z = self._messages(e)
        n, t, _ = e.shape
        rows = np.arange(n)[:, None]
        gold = e[rows, np.arange(t), y].sum(1) + self.p["T"][y[:, :-1], y[:, 1:]].sum(1)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        de = np.exp(a + b - z[:, None, None])
        de[rows, np.arange(t), y] -= 1
        pair = a[:, :-1, :, None] + self.p["T"] + (e + b)[:, 1:, None, :] - z[:, None, None, None]
        grads["T"] += np.exp(pair).sum((0, 1))
        np.add.at(grads["T"], (y[:, :-1], y[:, 1:]), -1)
        grads["V"] = np.einsum("nth,ntk->hk", both, de)
        grads["c"] = de.sum((0, 1))
        dboth = de @ self.p["V"].T
        dx = self._lstm_gradient(embedded, "f", sf, dboth[:, :, :HIDDEN], grads)
        dx += self._lstm_gradient(embedded, "b", sb, dboth[:, :, HIDDEN:], grads)
        np.add.at(grads["E"], x, dx)
        return float((z - gold).mean()), {k: v / n for k, v in grads.items()}


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def tags(length: int, spans: list[Span]) -> np.ndarray:
    """Tags of a window. A span that begins before it has no first character in it."""
    out = np.zeros(length, np.int64)
    for start, end, kind in spans:
        out[max(start, 0) : max(end, 0)] = 2 + 2 * kind
        if start >= 0:
            out[start] = 1 + 2 * kind
    return out


def train(texts: list[str]) -> Tagger | None:
    """A tagger from spans the patterns label in ``texts``, or nothing where they label none.

    Windows around digits and at signs are the examples. Each window with a span comes again with its
    spans in forms the patterns miss (``REWRITTEN``), taken in turn.
    """
    xs, ys, turn = [], [], 0
    for text in texts:
        if len(xs) >= MOST_WINDOWS:
            break
        spans = base_spans(text)
        for start, end in _regions(text):
            inside = [(s - start, e - start, k) for s, e, k in spans if s < end and e > start]
            examples = [(text[start:end], inside)]
            if other := rewritten(*examples[0], turn):
                examples.append(other)
                turn += 1
            for piece, own in examples:
                x, y = np.full(WIDTH, PAD), np.zeros(WIDTH, np.int64)
                n = min(WIDTH, len(piece))
                x[:n], y[:n] = codes(piece)[:n], tags(max(len(piece), 1), own)[:n]
                xs.append(x)
                ys.append(y)
    if not any(y.any() for y in ys):
        return None
    x, y = np.array(xs[:MOST_WINDOWS]), np.array(ys[:MOST_WINDOWS])
    model, r = Tagger.new(), np.random.default_rng(11)
    first, second = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}
    for step in range(1, STEPS + 1):
        part = r.integers(0, len(x), min(BATCH, len(x)))
        _, grads = model.gradient(x[part], y[part])
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.p[k] = model.p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return model


def _grouped(text: str, glue: str, size: int) -> str:
    digits = "".join(DIGIT.findall(text))
    return glue.join(digits[i : i + size] for i in range(0, len(digits), size))


# Forms of each kind that the patterns miss.
REWRITTEN = (
    (lambda s: s.replace("@", " @ "), lambda s: s.replace("@", "@ "), lambda s: " . ".join(s.rsplit(".", 1))),
    (lambda s: s.replace(".", " . "), lambda s: s.replace(".", "[.]")),
    (lambda s: _grouped(s, ".", 4), lambda s: _grouped(s, "/", 4), lambda s: _grouped(s, "  ", 4)),
    (
        lambda s: re.sub(r"^\+[0-9]{1,3}[ .-]?(?=[(0-9])", "", s), lambda s: "00" + s[1:],
        lambda s: "+" + _grouped(s, "/", 3), lambda s: _grouped(s, " ", 3), lambda s: _grouped(s, ".", 4),
    ),
)


def rewritten(piece: str, spans: list[Span], turn: int) -> tuple[str, list[Span]] | None:
    """The window with every span it holds whole in another form. None without such spans, or where spans overlap."""
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:])) or not any(s >= 0 and e <= len(piece) for s, e, _ in spans):
        return None
    out, own, at, grown = [], [], 0, 0
    for start, end, kind in spans:
        text = piece[max(start, 0) : end]
        if start >= 0 and end <= len(piece):
            text = REWRITTEN[kind][turn % len(REWRITTEN[kind])](text)
        out += [piece[at : max(start, 0)], text]
        at = min(end, len(piece))
        own.append((start + grown, end + grown, kind))
        if start >= 0 and end <= len(piece):
            grown += len(text) - (end - start)
            own[-1] = (own[-1][0], end + grown, kind)
    return "".join([*out, piece[at:]]), own


def _stretches(text: str) -> list[tuple[int, int]]:
    """Disjoint parts of the text within ``CONTEXT`` characters of a digit or at sign."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        low, high = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(low, high) for low, high in out]


def _windows(low: int, high: int) -> list[tuple[int, int]]:
    """Windows of at most ``WIDTH`` characters over a stretch, each half in the next one."""
    return [(a, min(a + WIDTH, high)) for a in range(low, max(low + 1, high - STRIDE + 1), STRIDE)]


def _regions(text: str) -> list[tuple[int, int]]:
    return [w for low, high in _stretches(text) for w in _windows(low, high)]


def _blocks(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Stretches as ``low, high, first, last``: what is decoded together, and where its spans may begin."""
    for low, high in _stretches(text):
        if high - low <= BLOCK:
            yield low, high, low, high
        else:
            for at in range(low, high, BLOCK):
                yield max(low, at - WIDTH), min(high, at + BLOCK + WIDTH), at, min(high, at + BLOCK)


def added_spans(model: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans the tagger adds to the base ones, none of which it touches.

    Only what lies around digits and at signs is decoded, as a span without either is never added. Windows
    give emissions; those of a stretch are joined in the middle of their overlaps, and one best path with the
    transitions runs over the whole stretch. A span counts if its least sure character has a probability of
    ``LEAST_MARGIN`` given the stretch. Memory does not grow with the texts: about 512 windows are held.
    """
    found: list[list[Span]] = [[] for _ in texts]
    part: list[tuple] = []
    held = 0
    for i, text in enumerate(texts):
        for block in _blocks(text):
            windows = _windows(*block[:2])
            part.append((i, block, windows))
            held += len(windows)
            if held >= 512:
                _decode(model, texts, base, part, found)
                part, held = [], 0
    if part:
        _decode(model, texts, base, part, found)
    return found


def _decode(model: Tagger, texts: list[str], base: list[list[Span]], part: list[tuple], found: list[list[Span]]) -> None:
    """Append the spans of these blocks to ``found``."""
    where = [(i, a, b) for i, _, windows in part for a, b in windows]
    x = np.full((len(where), WIDTH), PAD)
    for k, (i, a, b) in enumerate(where):
        x[k, : b - a] = codes(texts[i][a:b])
    emitted, _ = model.emissions(x)
    joined, at = [], 0
    for i, block, windows in part:
        joined.append((i, block, stitched(emitted[at : at + len(windows)], windows)))
        at += len(windows)
    # Blocks of like length are padded to one length. Behind a block all is outside, as in training.
    order = sorted(range(len(joined)), key=lambda k: len(joined[k][2]))
    spans: dict[int, list[Span]] = {}
    while order:
        n = 1
        while n < len(order) and (n + 1) * len(joined[order[n]][2]) <= 1 << 16:
            n += 1
        group, order = order[:n], order[n:]
        e = np.full((n, len(joined[group[-1]][2]) + 1, TAGS), -1e4)
        e[:, :, 0] = 0.0
        for row, k in enumerate(group):
            e[row, : len(joined[k][2])] = joined[k][2]
        path = model.best_path(e)
        mine = {}
        for row, k in enumerate(group):
            i, (low, _, first, last), own = joined[k]
            mine[row] = [
                s for s in _path_spans(path[row, : len(own)], low) if first <= s[0] < last and _plausible(texts[i][s[0] : s[1]], s[2])
                and s[1] - s[0] >= SHORTEST and not any(a < s[1] and s[0] < b for a, b, _ in base[i])
            ]
        open_rows = [row for row in mine if mine[row]]
        if open_rows:
            for row, m in zip(open_rows, model.marginals(e[open_rows]), strict=True):
                low, k = joined[group[row]][1][0], group[row]
                for s in mine[row]:
                    inside = np.arange(s[0] - low, s[1] - low)
                    if m[inside, path[row, inside]].min() >= LEAST_MARGIN:
                        spans.setdefault(k, []).append(s)
    for k, (i, _, _) in enumerate(joined):
        found[i] += spans.get(k, [])


def stitched(e: np.ndarray, windows: list[tuple[int, int]]) -> np.ndarray:
    """Emissions of a stretch from those of its windows, each up to the middle of its overlap with the next."""
    seams = [(b + c) // 2 for (_, b), (c, _) in zip(windows, windows[1:])]
    limits = [windows[0][0], *seams, windows[-1][1]]
    return np.concatenate([e[k, low - a : high - a] for k, ((a, _), low, high) in enumerate(zip(windows, limits, limits[1:]))])


def _path_spans(path: np.ndarray, low: int) -> Iterator[Span]:
    for at in np.flatnonzero(path % 2 == 1):
        kind, end = int(path[at] - 1) // 2, int(at) + 1
        while end < len(path) and path[end] == 2 + 2 * kind:
            end += 1
        yield low + int(at), low + end, kind


def _plausible(piece: str, kind: int) -> bool:
    digits = "".join(DIGIT.findall(piece))
    if kind == 0:
        name, _, host = piece.partition("@")
        return bool(name.strip()) and "." in host.strip(" .")
    if kind == 1:
        parts = re.findall("[0-9]+", piece)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and set(piece) <= set("+0123456789 ().-/")


# ---- Spark ---------------------------------------------------------------------------------


def sample_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """About ``MOST_DOCUMENTS`` texts with a digit or at sign, by the hash of identifier and text."""
    rows = with_ids(docs, id_col, text_col).filter(F.col("_text").rlike("[0-9@]") & (F.octet_length("_text") < LONGEST))
    picked = bounded_sample(rows, MOST_DOCUMENTS, "_id", "_text").select(F.xxhash64("_id", "_text").alias("at"), "_text")
    return [r["_text"] for r in sorted(picked.collect(), key=lambda r: r["at"])]


def find(docs: DataFrame, model: Tagger | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: start, end (code points), kind and whether a pattern found it (``base``), in order.

    Null and empty texts have no spans. Every row is searched, repeated or not, over its whole text;
    an empty table gives an empty result. A column named ``spans`` is replaced.
    """
    return _searched(docs, model, text_col, mask=False)


def mask(docs: DataFrame, model: Tagger | None, text_col: str = "text") -> DataFrame:
    """As ``find``, with every span of the text replaced by its kind in angle brackets.

    Of overlapping spans the first counts. ``spans`` are places in the text as it was. Null stays null.
    """
    return _searched(docs, model, text_col, mask=True)


def _searched(docs: DataFrame, model: Tagger | None, text_col: str, mask: bool) -> DataFrame:
    others = [c for c in docs.columns if c != "spans"]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
    schema = ", ".join([*kinds, "spans array<struct<start:int,end:int,kind:string,base:boolean>>"])
    fields = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast(model.p if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value) if shared.value else None
        for part in slices(batches, text_col):
            given = part.column(text_col).to_pylist()
            texts = [t or "" for t in given]
            base = [base_spans(t) for t in texts]
            more = added_spans(tagger, texts, base) if tagger else [[] for _ in texts]
            spans = [
                sorted([(*x, True) for x in b] + [(*x, False) for x in a], key=lambda x: (x[0], x[2]))
                for b, a in zip(base, more, strict=True)
            ]
            columns = {c: part.column(c) for c in others}
            if mask:
                columns[text_col] = pa.array([masked(t, s) if s else t for t, s in zip(given, spans, strict=True)], pa.string())
            rows = [[{"start": s, "end": e, "kind": KINDS[k], "base": own} for s, e, k, own in found] for found in spans]
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(rows, pa.list_(fields))], [*others, "spans"])

    return docs.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple]) -> str:
    out, at = [], 0
    for start, end, kind, *_ in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
