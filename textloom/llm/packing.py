"""Packing of token pieces into sequences by bound-certified best-fit decreasing."""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.arrow import slices
from textloom.llm.bpe import ENCODED_BYTES, encoder
from textloom.llm.common import store, with_ids

GROUP_ROWS = 100_000
LARGEST_K = 20

log = logging.getLogger(__name__)


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text",
    with_tokens: bool = True,
) -> DataFrame:
    """Every text as token pieces of at most ``capacity``: ``id_col, piece, start, length, ids_crc32, ids``.

    ``end_id`` closes each document. Only documents longer than ``capacity`` are cut. Null texts
    count as empty and give the end id alone. Repeated rows give repeated pieces. An empty table
    gives no pieces. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_tokens
    schema = f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in slices(batches, "_text", ENCODED_BYTES):
            ids, ends = enc.encode_all(part.column("_text"), (end_id,))
            begins = np.concatenate([[0], ends[:-1]])
            count = -(-(ends - begins) // capacity)
            row = np.repeat(np.arange(len(ends)), count)
            piece = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
            at = begins[row] + piece.astype(np.int64) * capacity
            stop = np.minimum(at + capacity, ends[row])
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), stop.tolist(), strict=True)]
            columns = [
                part.column("_id").take(pa.array(row)), pa.array(piece), pa.array(piece.astype(np.int64) * capacity),
                pa.array(stop - at), pa.array(sums, pa.int64()),
            ]
            if with_tokens:
                cuts = pa.array(np.append(at, len(ids)).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(cuts, pa.array(ids.view("<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names)

    return with_ids(docs, id_col, text_col).mapInArrow(cut, schema).withColumnRenamed("_id", id_col)


def pack(table: DataFrame, capacity: int, length_col: str = "length", group_rows: int = GROUP_ROWS) -> DataFrame:
    """The narrow ``table`` of pieces with ``sequence_id`` and ``offset``: sequences of at most ``capacity``.

    Pieces are dealt evenly to partitions, and each partition packs its own by best-fit decreasing.
    Lower bounds from dual feasible functions certify a partition whose number of sequences cannot
    be undercut. The pieces of the sequences that are not full in the other partitions are dealt
    anew among these and packed again, until at most one such partition is left or a round saves no
    sequence; such a round is dropped. The log names the sequences above the bounds that then remain.

    Lengths are 1 to ``capacity``; a null length or one outside raises an error. Ties go to the
    earlier row. Columns named ``sequence_id`` or ``offset`` are replaced.
    """
    table = table.drop("sequence_id", "offset")
    rows = store(table.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    open_ = rows.select("_row", F.col(length_col).cast("long").alias("_size"))
    count, done, held, before, turn = rows.count(), [], None, 0, 0
    while True:
        groups = max(1, -(-count // group_rows))
        dealt = open_.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(groups)))
        schema = "_row bigint, _size bigint, _group bigint, _bin bigint, _offset bigint, _full boolean, _gap bigint"
        packed = store(dealt.groupBy("_group").applyInPandas(_packer(capacity), schema), "packed")
        left = packed.groupBy("_group").agg(
            F.max("_bin").alias("_last"), F.first("_gap").alias("_gap"), F.count_if(~F.col("_full")).alias("_open"),
            F.count_if(F.col("_full") & (F.col("_offset") == 0)).alias("_done"),
        )
        loose = F.col("_gap") > 0
        made, partitions, count, open_bins, gap = left.agg(
            F.sum(F.col("_last") + 1), F.count_if(loose), F.sum(F.when(loose, F.col("_open"))),
            F.sum(F.when(loose, F.col("_last") + 1 - F.col("_done"))), F.sum("_gap"),
        ).first()
        if held is not None and made >= before:
            done.append(held)
            gap = above
            break
        number = (F.lit(turn).cast("long") * (1 << 50)) + F.col("_group") * (1 << 24) + F.col("_bin")
        placed = packed.select("_row", number.alias("sequence_id"), F.col("_offset").alias("offset"), "_gap", "_full")
        if partitions <= 1:
            done.append(placed.drop("_gap", "_full"))
            break
        done.append(placed.filter("_gap = 0 or _full").drop("_gap", "_full"))
        held = placed.filter("_gap > 0 and not _full").drop("_gap", "_full")
        open_ = packed.filter("_gap > 0 and not _full").select("_row", "_size")
        before, above, turn = open_bins, gap, turn + 1
    if gap:
        log.warning("packing: %d sequences above the bounds of their partitions after %d rounds", gap, turn + 1)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return rows.join(result, "_row").drop("_row")


def _packer(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_size", "_row"], ascending=[False, True], kind="stable")
        sizes = group["_size"].to_numpy()
        if len(sizes) and not (sizes.min() >= 1 and sizes.max() <= capacity):
            raise ValueError(f"lengths must be 1 to {capacity}")
        bins, offsets, room = best_fit(sizes, capacity)
        gap = len(room) - lower_bound(sizes, capacity)
        return group.assign(_bin=bins, _offset=offsets, _full=room[bins] == 0, _gap=gap)[
            ["_row", "_size", "_group", "_bin", "_offset", "_full", "_gap"]
        ]

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each size, in the order given, and the room left in each sequence.

    Each size goes to the fullest sequence that holds it. Sequences wait in lists by their room; the
    set of rooms that occur is one integer, whose lowest bit from ``size`` on is the best fit.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, left = 0, []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            target = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, target = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = target, capacity - room
        rest = left[target] = room - size
        if rest:
            waiting[rest].append(target)
            rooms |= 1 << rest
    return bins, offsets, np.array(left, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The largest bound from two families of dual feasible functions, in integers."""
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    mass, number = np.cumsum(counts * x), np.cumsum(counts)
    cut = np.arange(1, capacity // 2 + 1)  # sizes below the cut vanish, sizes above capacity - cut fill a sequence
    high = number[-1] - number[capacity - cut]
    middle = mass[capacity - cut] - mass[cut - 1]
    best = max(-(-int(mass[-1]) // capacity), int((high + -(-middle // capacity)).max(initial=0)))
    for k in range(1, LARGEST_K + 1):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best
