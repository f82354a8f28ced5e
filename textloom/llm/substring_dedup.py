"""Removal of passages that repeat across documents, by a suffix order of candidate strings."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm import suffix_bwt
from textloom.llm.arrow import slices
from textloom.llm.common import store, with_ids
from textloom.llm.hashing import BYTES, STEP, U, buffers, mix, prefix_hashes
from textloom.session import BROADCAST_LIMIT

GRAM = 16  # an anchor is the gram of the least hash in a window
BUCKET_BYTES = 8 * 1024 * 1024  # of text per bucket; a segment repeats its neighbours' bytes, about 3.5 times
HOT_PARTS = 1000
HOT_SHARE, HOT_LEAST = 8, 8  # an anchor is hot with 1/8 of a bucket's text, and so many segments in the sample
SAMPLE_BYTES, SAMPLE_PART = 16 * 1024 * 1024, 2000  # of text, or 1/2000 of all
HASHED_BYTES, PACKED_BYTES = 1024 * 1024, 16 * 1024 * 1024  # of text at once
ANSWERED = 1 << 20  # windows at once
_CODEC = "zstd"


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` neighbouring bytes, put together from windows of powers of two."""
    power, out, done = BYTES[data], None, 0
    size = 1
    while True:
        if width & size:
            out = power if out is None else _joined(out[: len(power) - done], power[done:])
            done += size
        if done == width:
            return mix(out[: len(data) - width + 1])
        power = _joined(power[:-size], power[size:])
        size *= 2


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * STEP
    out += b
    out ^= out >> U(29)
    return out


def _least(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def segments(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``width`` bytes with the same anchor: document, first byte, windows, anchor's place, hash.

    The anchor of a window is its leftmost gram of the least hash, so equal windows have equal
    anchors at equal places, wherever they occur. A segment has at most ``width - GRAM + 1`` windows.
    """
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none, np.zeros(0, U)
    place = np.arange(len(data) - GRAM + 1, dtype=U)
    least = _least((window_hashes(data, GRAM) >> U(32) << U(32)) | place, width - GRAM + 1)
    start = np.arange(len(least))
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(least)]
    inside = start + width <= ends[doc + 1]
    start, least, doc = start[inside], least[inside], doc[inside]
    if not len(start):
        return none, none, none, none, np.zeros(0, U)
    new = np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(start)))
    at = (least[first] & U(0xFFFFFFFF)).astype(np.int64)
    return doc[first], start[first], windows, at - start[first], mix(least[first] >> U(32))


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return data[:0]
    step = np.ones(int(ends[-1]), np.int64)
    step[0] = starts[0]
    step[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1]) + 1
    return data[np.cumsum(step)]


def _blocks(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most`` in sum."""
    if not len(sizes):
        return []
    ends = np.cumsum(sizes)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]), most)))
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(sizes)], strict=True))


def _differ(data: np.ndarray, starts: np.ndarray, others: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which strings differ from their other one, byte by byte."""
    out = lengths != sizes
    rows = np.flatnonzero(~out & (starts != others))
    for a, b in _blocks(lengths[rows], HASHED_BYTES):
        own, size = rows[a:b], lengths[rows[a:b]]
        unequal = _gathered(data, starts[own], size) != _gathered(data, others[own], size)
        out[own] = np.logical_or.reduceat(unequal, np.cumsum(size) - size)
    return out


def classes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each string and the first of each class of equal strings. Equal strings have equal keys; bytes decide."""
    key = key.copy()
    while True:
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        differ = _differ(data, starts, starts[one][which], lengths, lengths[one][which])
        if not differ.any():
            return which, one
        key[differ] = mix(key[differ] + U(1))


def _settled(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which strings have an equal one with a smaller identifier here. Strings come in order."""
    out = np.zeros(len(ids), bool)
    some = np.flatnonzero(_spread(key, ids))
    if len(some):
        begin, size = starts[some], lengths[some]
        content = mix(prefix_hashes(data, begin, begin + size, (), lower=False)[0] + key[some])
        which, one = classes(data, begin, size, content)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids[some])
        out[some] = least[which] < ids[some]
    return out


def _cutter(width: int, buckets: int, hot: np.ndarray | None = None):
    """One packed and compressed row per bucket and about 16 MB of text.

    All windows of a segment go if an equal segment of the same 16 MB has a smaller identifier, so
    these are answered here, in rows with a negative bucket, and a bucket gets one of them only.
    Segments with an anchor in ``hot`` are then cut into single windows, which are answered in the
    same way and spread over the buckets by a hash of their bytes.
    """

    def reduced(data, columns, key):
        """The columns of the strings that stay open, and the ranges of the others."""
        ids, subs, here, first, windows, _, _ = columns
        size = windows + width - 1
        done = _settled(data, here, size, key, ids)
        begin, end, text = first[done], (first + size)[done], (here - first)[done]
        new, last = np.ones(len(begin), bool), np.ones(len(begin), bool)
        new[1:] = (text[1:] != text[:-1]) | (begin[1:] > end[:-1])
        last[:-1] = new[1:]
        return [c[~done] for c in columns], (ids[done][new], subs[done][new], begin[new], end[last])

    def packed(parts: list[tuple]) -> pa.RecordBatch:
        texts, ids, subs, start, windows, anchor, h, base = zip(*parts, strict=True)
        data = np.concatenate(texts)
        ids, subs, windows, anchor, h = (np.concatenate(x) for x in (ids, subs, windows, anchor, h))
        start, base = np.concatenate(start), np.concatenate(base)
        shift = np.cumsum([0, *(len(t) for t in texts[:-1])])
        here = start + np.repeat(shift, [len(p[3]) for p in parts])
        columns, ranges = reduced(
            data, [ids, subs, here, start - base, windows, anchor, h], mix(h ^ (windows * 256 + anchor).astype(U))
        )
        if hot is not None and len(hot):
            split = hot[np.minimum(np.searchsorted(hot, columns[6]), len(hot) - 1)] == columns[6]
            ids, subs, here, first, windows, anchor, _ = (c[split] for c in columns)
            row = np.repeat(np.arange(len(ids)), windows)
            k = np.arange(len(row)) - (np.cumsum(windows) - windows)[row]
            at = here[row] + k
            own = mix(prefix_hashes(data, at, at + width, (), lower=False)[0])
            single = [ids[row], subs[row], at, first[row] + k, np.ones(len(row), np.int64), anchor[row] - k, own]
            single, more = reduced(data, single, own)
            columns = [np.concatenate([c[~split], x]) for c, x in zip(columns, single, strict=True)]
            ranges = tuple(np.concatenate(x) for x in zip(ranges, more, strict=True))
        ids, subs, here, first, windows, anchor, h = columns
        bucket = (h % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, heads = np.unique(bucket[order], return_index=True)
        blobs = []
        for own in np.split(order, heads[1:]) if len(found) else []:
            fields = (
                ids[own].astype("<i8"), subs[own].astype("<i8"), first[own].astype("<i8"),
                windows[own].astype("u1"), anchor[own].astype("u1"), _gathered(data, here[own], windows[own] + width - 1),
            )
            blobs.append(_closed(len(own).to_bytes(8, "little") + b"".join(x.tobytes() for x in fields)))
        found = found.tolist()
        if len(ranges[0]):
            found.append(-1 - int(mix(ranges[0][:1].astype(U))[0] >> U(2)))  # any place will do
            blobs.append(_closed(b"".join(x.astype("<i8").tobytes() for x in ranges)))
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "_text", HASHED_BYTES):
            data, ends = buffers(part.column("_text"))
            doc, start, windows, anchor, h = segments(data, ends, width)
            ids, subs = part.column("_id").to_numpy()[doc], part.column("_sub").to_numpy()[doc]
            held.append((data, ids, subs, start, windows, anchor, h, ends[doc]))
            size += len(data)
            if size >= PACKED_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return run


def _closed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, _CODEC, asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), _CODEC, asbytes=True), np.uint8)


def _weights(width: int):
    """Segments of every anchor and the bytes of text they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", HASHED_BYTES):
            _, _, windows, _, h = segments(*buffers(part.column("_text")), width)
            found, which, n = np.unique(h, return_inverse=True, return_counts=True)
            weight = np.bincount(which, windows, len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n), pa.array(weight)], ["h", "n", "weight"])

    return run


def _hot_anchors(cut: DataFrame, width: int, total: int) -> np.ndarray:
    """Hashes of the anchors that would fill much of a bucket, by a sample. Only the exchange depends on them."""
    share = min(1.0, max(SAMPLE_BYTES, total // SAMPLE_PART) / max(1, total))
    sample = cut if share == 1 else cut.filter(F.rand(11) < share)
    weights = sample.select("_text").mapInArrow(_weights(width), "h bigint, n bigint, weight bigint")
    sums = weights.groupBy("h").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    found = sums.filter((F.col("n") >= HOT_LEAST) & (F.col("weight") * HOT_SHARE > share * BUCKET_BYTES)).select("h")
    return np.sort(np.array([r.h for r in found.collect()], np.int64).view(U))


def _opened(blobs: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Identifier, sub-identifier, first byte, windows, anchor's place and bytes of all segments of a bucket."""
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    for blob in blobs:
        raw = _unpacked(blob)
        n = int(raw[:8].view("<i8")[0])
        cuts = np.cumsum([8, 8 * n, 8 * n, 8 * n, n, n])
        for k, kind in enumerate(("<i8", "<i8", "<i8", "u1", "u1")):
            parts[k].append(raw[cuts[k] : cuts[k + 1]].view(kind).astype(np.int64))
        parts[5].append(raw[cuts[5] :])
    return tuple(np.concatenate(p) for p in parts)


def repeated(blobs: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Ranges of a bucket's documents that a smaller identifier holds as well: identifier, sub-identifier, start, end.

    Segments whose anchor occurs in one document only are dropped and segments with the same bytes become
    one with their smallest identifier. A string that is alone with its anchor has its own windows only.
    Where several share an anchor, those that share the hash of a window go into one
    Burrows-Wheeler transform, and windows are equal where the common prefixes say so.
    """
    ids, subs, first, windows, anchor, data = _opened(blobs, width)
    lengths = windows + width - 1
    starts = np.cumsum(lengths) - lengths
    grams = np.zeros(len(ids), U)
    for k in range(GRAM):
        grams = mix(grams * STEP + BYTES[data[starts + anchor + k]])
    shared = _spread(grams, ids)
    ids, subs, first, windows, starts, lengths, grams = (
        x[shared] for x in (ids, subs, first, windows, starts, lengths, grams)
    )
    if not len(ids):
        return ids, subs, first, first
    content = mix(prefix_hashes(data, starts, starts + lengths, (), lower=False)[0] + grams)
    which, one = classes(data, starts, lengths, content)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    starts, lengths, kinds, grams = starts[one], lengths[one], windows[one], grams[one]
    offset = np.cumsum(kinds) - kinds  # of each string's windows
    smallest = np.repeat(least, kinds)
    again = np.flatnonzero(_spread(grams, np.arange(len(one))))
    again = again[_share_window(data, starts[again], lengths[again], width)] if len(again) else again
    if len(again):
        folder = tempfile.mkdtemp(prefix="bwt-")
        try:
            own = _gathered(data, starts[again], lengths[again])
            size = lengths[again]
            found = suffix_bwt.build(own, np.cumsum(size) - size, size, folder)
        finally:
            shutil.rmtree(folder)
        at = np.flatnonzero(found.length >= width)
        string = again[found.string[at]]
        group = np.cumsum(found.common[at] < width)
        # Between two windows with a common prefix of ``width`` no shorter suffix can stand.
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        low = np.minimum.reduceat(least[string], heads)
        smallest[offset[string] + lengths[string] - found.length[at]] = np.repeat(low, np.diff(np.append(heads, len(at))))
    parts = []
    for a, b in _blocks(windows, ANSWERED):
        size = windows[a:b]
        row = a + np.repeat(np.arange(b - a), size)
        k = np.arange(len(row)) - (np.cumsum(size) - size)[row - a]
        gone = smallest[offset[which[row]] + k] < ids[row]
        before = np.append(False, gone[:-1]) & (k > 0)
        after = np.append(gone[1:], False) & (k + 1 < windows[row])
        opening, closing = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
        row_of = row[opening]
        parts.append((ids[row_of], subs[row_of], first[row_of] + k[opening], first[row_of] + k[closing] + width))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _spread(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the rows with the same key hold several values."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    v = value[order]
    several = np.minimum.reduceat(v, heads) < np.maximum.reduceat(v, heads)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(several, np.diff(np.append(heads, len(key))))
    return out


def _share_window(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Which strings hold a window of another one, by 64-bit hashes."""
    hashes, owners = [], []
    cuts = np.searchsorted(np.cumsum(lengths), np.arange(0, int(lengths.sum()), HASHED_BYTES))
    for a, b in zip(cuts, [*cuts[1:], len(starts)], strict=True):
        own, size = _gathered(data, starts[a:b], lengths[a:b]), lengths[a:b]
        if len(own) < width:
            continue
        h = window_hashes(own, width)
        string = np.repeat(np.arange(b - a, dtype=np.int32), size)[: len(h)]
        inside = np.arange(len(h)) + width <= np.cumsum(size)[string]
        hashes.append(h[inside])
        owners.append(string[inside] + np.int32(a))
    owner = np.concatenate(owners)
    many = np.zeros(len(starts), bool)
    many[owner[_spread(np.concatenate(hashes), owner)]] = True
    return many


def _finder(width: int):
    fields = [("_id", pa.int64()), ("_sub", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(columns):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [n for n, _ in fields])

        current, held = None, []  # rows come sorted by bucket
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if bucket < 0:
                    yield done(_unpacked(blob).view("<i8").reshape(4, -1))
                    continue
                if bucket != current and held:
                    yield done(repeated(held, width))
                    held = []
                current = bucket
                held.append(blob)
        if held:
            yield done(repeated(held, width))

    return run


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, spans, kept``: the bytes of every text that no smaller identifier holds.

    A byte goes if a string of ``width`` bytes around it starts in a document with a smaller
    identifier as well; ``spans`` are the maximal runs that go (start, end in bytes), ``kept`` is the
    rest as binary. Strings never cross documents and are compared as the texts were given.

    Texts are cut into segments of windows with a common anchor. Of equal segments in 16 MB of text only
    those with the smallest identifier are exchanged by anchor, packed and compressed per bucket of
    about 8 MB of text; the others are answered at once. Segments of an anchor that would fill 1/8 of a
    bucket, by a sample, are exchanged window by window. Each bucket inserts its candidate strings
    column by column into one Burrows-Wheeler transform with common prefixes, in sequential files of
    the task's temporary folder, which are deleted when the bucket is done. A text that 1/1000 of all
    rows hold (at most 1000 do) takes part once; its other copies go whole.

    Null texts count as empty. Identifiers are integers; null ones come after all others, and rows with
    the same identifier never remove each other's bytes. An empty table gives an empty result. Other
    columns are not read.
    """
    rows = with_ids(docs, id_col, text_col).withColumns({
        "_given": F.col("_id"), "_id": F.coalesce(F.col("_id").cast("long"), F.lit((1 << 63) - 1)),
        "_n": F.octet_length("_text").cast("long"),
    })
    facts = store(rows.select("_id", "_n", F.sha2("_text", 256).alias("_sha")), "text-digests")
    count, total = facts.agg(F.count("*"), F.sum("_n")).first()
    again = not facts.groupBy("_id").count().filter("count > 1").isEmpty()
    rows = rows.withColumn("_sub", F.xxhash64("_text") if again else F.lit(0).cast("long"))
    hot = (
        facts.filter(F.col("_n") >= width).groupBy("_sha").agg(F.count("*").alias("_c"), F.min("_id").alias("_first"))
        .filter((F.col("_c") > 1) & (F.col("_c") * HOT_PARTS >= count)).drop("_c")
    )
    rows = rows.withColumn("_sha", F.sha2("_text", 256)).join(F.broadcast(hot), "_sha", "left").withColumn(
        "_copy", F.coalesce(F.col("_id") > F.col("_first"), F.lit(False))
    )
    buckets = max(1, -(-(total or 0) // BUCKET_BYTES))
    cut = rows.filter((F.col("_n") >= width) & ~F.col("_copy")).select("_id", "_sub", "_text")
    hot_anchors = _hot_anchors(cut, width, total) if buckets > 1 else None
    pieces = cut.mapInArrow(_cutter(width, buckets, hot_anchors), "bucket bigint, data binary")
    ranges = pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _finder(width), "_id bigint, _sub bigint, start bigint, end bigint"
    )
    grouped = ranges.groupBy("_id", "_sub").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = store(grouped.mapInArrow(_merged_spans, f"_id bigint, _sub bigint, spans {_SPANS}"), "spans")
    size = spans.agg(F.sum(64 + 24 * F.size("spans"))).first()[0] or 0
    # Spans proven to be small are broadcast, so that texts stay where they are.
    spans = F.broadcast(spans) if size <= BROADCAST_LIMIT else spans
    joined = rows.join(spans, ["_id", "_sub"], "left").select("_given", "_text", "_n", "_copy", "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.mapInArrow(_removed, f"_id {kind}, n_bytes bigint, spans {_SPANS}, kept binary")
    return out.withColumnRenamed("_id", id_col)


_SPANS = "array<struct<start:bigint,end:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"start": a, "end": b} for a, b in merged(r)] for r in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_sub"), pa.array(spans, _SPAN_TYPE)], ["_id", "_sub", "spans"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text"):
        data, ends = buffers(part.column("_text"))
        spans, kept = [], []
        ranges, copies = part.column("spans"), part.column("_copy").to_pylist()
        for i, copy in enumerate(copies):
            a, b = int(ends[i]), int(ends[i + 1])
            own = [(0, b - a)] if copy else [(r["start"], r["end"]) for r in ranges[i].as_py() or []]
            spans.append([{"start": x, "end": y} for x, y in own])
            out, at = [], a
            for x, y in own:
                out.append(data[at : a + x])
                at = a + y
            kept.append(b"".join([x.tobytes() for x in [*out, data[at:b]]]))
        yield pa.RecordBatch.from_arrays(
            [part.column("_given"), part.column("_n"), pa.array(spans, _SPAN_TYPE), pa.array(kept, pa.binary())],
            ["_id", "n_bytes", "spans", "kept"],
        )


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one, in order."""
    out: list[tuple[int, int]] = []
    for r in sorted((r["start"], r["end"]) for r in ranges or []):
        if out and r[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r[1]))
        else:
            out.append(r)
    return out
