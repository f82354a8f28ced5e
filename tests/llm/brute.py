"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np

from tests.oracle import sf_dir

FOLDER = sf_dir("0.001")
UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def documents(folder: str = FOLDER) -> dict[int, str]:
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet'").fetchall()
    return dict(rows)


def repeats(docs: dict[int, str], width: int = 50) -> dict[int, tuple]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    seen, out = {}, {}
    for i in sorted(docs):
        b = docs[i].encode()
        gone = np.zeros(len(b), bool)
        windows = [b[k : k + width] for k in range(len(b) - width + 1)]
        for k, w in enumerate(windows):
            if seen.get(w, i) < i:
                gone[k : k + width] = True
        for w in windows:
            seen.setdefault(w, i)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()
    return out


def shingles(text: str) -> set[tuple]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(UPPER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near(docs: dict[int, str]) -> dict[int, tuple]:
    """n_shingles and component of each document."""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    for a, b in {(a, b) for own in having.values() for a in own for b in own if a < b}:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in docs}


def spans(text: str) -> list[tuple[int, int, str]]:
    def luhn(d):
        v = [int(x) for x in d[::-1]]
        return sum(v[::2] + [sum(divmod(2 * x, 10)) for x in v[1::2]]) % 10 == 0

    found = [(m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.span(), "phone"))
    kinds = ["email", "ip", "card", "phone"]
    return [(a, b, k) for (a, b), k in sorted(found, key=lambda x: (x[0][0], kinds.index(x[1])))]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
