"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.arrow import slices
from textloom.llm.common import bounded_sample, with_ids
from textloom.llm.hashing import U, buffers, mix, prefix_hashes, words

PREFIXES = (4, 5, 6)  # bytes
MOST_PER_CLASS = {1: 1500, 0: 3500}  # documents fitted on, per label
MOST_BYTES = 64 * 1024 * 1024  # and the text they may hold
LEAST_SEEN = 3
ROUNDS = 800
RATE = 0.3
BIAS = -5.0
BITMAP = 22
OFFENDING = 0.5
REJECT = 0.3

# Letters are A-Z, a-z and every byte of a longer character; sentences end at . ! ? or a line end.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
ENDS = np.zeros(256, np.int64)
ENDS[[10, 33, 46, 63]] = 1


@dataclass
class Model:
    """``score`` = 1 - product of (1 - p) over sentences, p = sigmoid(bias + sum of the features' weights)."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.seen = np.zeros(1 << BITMAP, bool)
        self.seen[self.keys >> U(64 - BITMAP)] = True

    def lookup(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        at = np.flatnonzero(self.seen[h >> U(64 - BITMAP)])
        if len(at) and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            hit = self.keys[place] == h[at]
            out[at[hit]] = self.weights[place[hit]]
        return out

    def sentences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, first byte, last byte and probability of each sentence that has words."""
        starts, stops, doc, first, features = instances(texts)
        z = np.add.reduceat(sum(self.lookup(f) for f in features), first) if len(first) else np.zeros(0)
        last = np.append(first[1:], len(starts)) - 1 if len(first) else first
        return doc, starts[first], stops[last], 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def instances(texts: pa.Array):
    """Words with their features, and the sentences: document and first word of each."""
    data, ends = buffers(texts)
    starts, stops = words(data, ends, BETWEEN)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, [np.zeros(0, U)] * (1 + len(PREFIXES))
    doc = np.searchsorted(ends, starts, "right") - 1
    closed = np.cumsum(ENDS[data])[starts]
    new = np.append(True, (np.diff(closed) > 0) | (np.diff(doc) > 0))
    first = np.flatnonzero(new)
    raw = prefix_hashes(data, starts, stops, PREFIXES)
    features = [mix(h + U((k + 1) * 0x224BAED4963EE407 % (1 << 64))) for k, h in enumerate(raw)]
    return starts, stops, doc[first], first, features


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """Weights that maximise the likelihood of document labels under noisy-or, by full-batch Adagrad.

    Features are words and their first bytes whose occurrence in documents depends on the label by
    the likelihood-ratio test, at a level that lets about one of all features through by chance.
    Without both labels, or without words, the score is the prior of every sentence.
    """
    _, _, doc, first, features = instances(texts)
    if not len(first) or len(np.unique(labels)) < 2:
        return Model(np.zeros(0, U), np.zeros(0), BIAS)
    sentence = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(features[0]))))
    total = sum(len(np.unique(f)) for f in features)
    kept = [_telling(f, sentence, doc, labels, total) for f in features]  # one kind of feature at a time, for memory
    keys, column = np.unique(np.concatenate([h for h, _ in kept]), return_inverse=True)
    where = np.concatenate([s for _, s in kept])
    w, bias = np.zeros(len(keys)), BIAS
    memory, memory_bias = np.full(len(keys), 1e-2), 1e-2
    y = labels.astype(float)
    for _ in range(ROUNDS):
        z = bias + np.bincount(where, w[column], len(first))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))  # log of no offending sentence
        some = np.maximum(-np.expm1(none), 1e-9)
        # d log-likelihood / dz: -p if the label is 0, p * (1 - P) / P if it is 1
        slope = p * np.where(y[doc] > 0, np.exp(none)[doc] / some[doc], -1.0)
        g = np.bincount(column, slope[where], len(keys))
        memory += g * g
        w += RATE * g / np.sqrt(memory)
        gb = slope.sum()
        memory_bias += gb * gb
        bias += RATE * gb / np.sqrt(memory_bias)
    return Model(keys, w, float(bias))


def _telling(h: np.ndarray, sentence: np.ndarray, doc: np.ndarray, labels: np.ndarray, total: int):
    """Occurrences, as feature and sentence, of the features that depend on the label."""
    order = np.argsort(h, kind="stable")
    h, sentence = h[order], sentence[order]
    new = np.append(True, h[1:] != h[:-1])
    group = np.cumsum(new) - 1
    once = np.flatnonzero(new | np.append(True, np.diff(doc[sentence]) != 0))  # once per feature and document
    n, positive = len(labels), int(labels.sum())
    both = np.bincount(group[once], labels[doc[sentence[once]]])
    seen = np.bincount(group[once]).astype(float)
    cells = [
        (both, seen * positive / n), (seen - both, seen * (n - positive) / n),
        (positive - both, (n - seen) * positive / n), (n - positive - seen + both, (n - seen) * (n - positive) / n),
    ]
    ratio = sum(np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0) for o, e in cells)
    keep = ((seen >= LEAST_SEEN) & (ratio > np.log(total)))[group]
    return h[keep], sentence[keep]


def fitting_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, id_col: str = "doc_id", text_col: str = "text",
) -> tuple[pa.Array, np.ndarray]:
    """About ``MOST_PER_CLASS`` labelled documents of each class, by the hash of their identifier.

    Of several labels of a document the largest counts.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_y in (0, 1)").filter(
        usable.isNotNull() & usable
    )
    picked = None
    for y, n in MOST_PER_CLASS.items():
        part = bounded_sample(known.groupBy("_id").agg(F.max("_y").alias("_y")).filter(F.col("_y") == y), n, "_id")
        picked = part if picked is None else picked.unionByName(part)
    rows = with_ids(docs, id_col, text_col).join(F.broadcast(picked), "_id").select("_text", "_y")
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    if total > MOST_BYTES:
        rows = rows.filter(F.pmod(F.xxhash64("_text"), F.lit(1000)) * total < 1000 * MOST_BYTES)
    table = rows.orderBy(F.xxhash64("_text"), "_text").toArrow().combine_chunks()  # the same order at every run
    if not table.num_rows:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    return table.column("_text").chunk(0), table.column("_y").to_numpy()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``offending``: start, end (code points) and score of each sentence from 0.5 on.

    Null texts count as empty; a text without words scores 0. Every row is scored, repeated or not;
    an empty table gives an empty result. Only the text enters a score. Columns named ``score`` or
    ``offending`` are replaced.
    """
    others = [c for c in docs.columns if c not in ("score", "offending")]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
    schema = ", ".join([*kinds, "score double", "offending array<struct<start:int,end:int,score:double>>"])
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))  # a few thousand features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for part in slices(batches, text_col):
            texts = part.column(text_col).fill_null("")
            doc, start, stop, p = own.sentences(texts)
            total = -np.expm1(np.bincount(doc, np.log1p(-p), part.num_rows)) if len(doc) else np.zeros(part.num_rows)
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            bad = np.flatnonzero(p >= OFFENDING)
            if len(bad):
                data, ends = buffers(texts)
                lead = (data & 0xC0) != 0x80  # first bytes of characters
                for i in np.unique(doc[bad]):
                    places = np.cumsum(lead[ends[i] : ends[i + 1]])
                    for s in bad[doc[bad] == i]:
                        a, b = start[s] - ends[i], stop[s] - ends[i]
                        found[i].append({"start": int(places[a]) - 1, "end": int(places[b - 1]), "score": float(p[s])})
            offending = pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
            columns = [part.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total), offending], [*others, "score", "offending"])

    return docs.mapInArrow(run, schema)
