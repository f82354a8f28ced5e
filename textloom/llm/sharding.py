"""Sharding by histogram sort. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.llm.common import store, whole

KEY_BITS = 60
DIGIT_BITS = 12  # a round refines a splitter by one digit
CELL_BYTES = 16 * 1024 * 1024
SNAP = 200  # a splitter moves to the edge of a group of equal texts that lies within 1/SNAP of a shard
HOT_PARTS = 1000


def shard(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard",
    slot_col: str = "slot", size_col: str = "size",
) -> DataFrame:
    """``docs`` with ``size_col``, ``shard_col`` and ``slot_col``: shards of nearly equal bytes.

    The sort key is (digest of the text, digest of the identifier), so equal texts are neighbours.
    Each round counts the exact bytes below the candidate boundaries inside the cells that hold a
    splitter, and refines these cells by 12 bits. A splitter ends at the edge of a group of equal
    texts if one lies within 1/200 of a shard, otherwise between two rows of the group that is
    there. The driver sees at most (shards - 1) * 4096 counts a round. Then the rows are exchanged
    once, to (shard, cell), and numbered; cells hold about 16 MB, and a text that holds 1/1000 of
    all bytes is cut into cells of its own by identifier.

    A size is the UTF-8 bytes of the text (null: none) plus 1. Rows that repeat identifier and text
    have one key; they stay together and are numbered in any order. A null identifier counts as the
    empty string. An empty table gives an empty result. Other columns pass through; those named
    like a new column are replaced.
    """
    new = [size_col, shard_col, slot_col]
    kept = [c for c in docs.columns if c not in new]
    text = whole(text_col)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), (F.octet_length(text) + 1).cast("long").alias("_size"),
        key_digest(text).alias("_a"), key_digest(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_b"),
    )
    keys = store(rows.select("_a", "_b", "_size"), "shard-keys")
    total = keys.agg(F.sum("_size")).first()[0] or 0
    bounds = splitters(keys, total, shards)
    bits = max(0, (max(total - 1, 0) // CELL_BYTES).bit_length())
    hot = (
        keys.groupBy("_a").agg(F.sum("_size").alias("_w"), F.count("*").alias("_n"))
        .filter((F.col("_n") > 1) & (F.col("_w") * HOT_PARTS >= total)).select("_a", F.lit(True).alias("_hot"))
    )
    cell = ["_shard", "_cell", "_part"]
    before = Window.partitionBy("_shard").orderBy("_cell", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = _placed(keys, bounds, bits, hot).groupBy(*cell).count().select(
        *cell, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    numbered = _placed(rows, bounds, bits, hot).withColumn(
        "_n", F.row_number().over(Window.partitionBy(*cell).orderBy("_a", "_b"))
    )
    return numbered.join(starts, cell, "left").select(
        *[F.col("_row").getField(c).alias(c) for c in kept], F.col("_size").alias(size_col),
        F.col("_shard").alias(shard_col), (F.col("_start") + F.col("_n") - 1).cast("long").alias(slot_col),
    )


def key_digest(c: Column) -> Column:
    """The first 60 bits of the MD5 digest."""
    return F.conv(F.substring(F.md5(c), 1, KEY_BITS // 4), 16, 10).cast("long")


def _placed(rows: DataFrame, bounds: list[tuple[int, int]], bits: int, hot: DataFrame) -> DataFrame:
    above = [((F.col("_a") > a) | ((F.col("_a") == a) & (F.col("_b") >= b))).cast("int") for a, b in bounds]
    part = F.when(F.col("_hot"), F.shiftright("_b", KEY_BITS - bits) + 1).otherwise(0)
    return rows.join(F.broadcast(hot), "_a", "left").withColumns({
        "_shard": sum(above, F.lit(0)), "_cell": F.shiftright("_a", KEY_BITS - bits), "_part": part,
    })


def splitters(keys: DataFrame, total: int, shards: int) -> list[tuple[int, int]]:
    """The first key (text digest, identifier digest) of each shard but the first."""
    targets = {i: (0, 0) for i in range(1, shards)} if total else {}
    groups = _refined(keys, {i: (F.lit(True), 0) for i in targets}, "_a", total, shards)
    bounds, inside = {}, {}
    for i, (value, start, size) in groups.items():
        edge = min((start, start + size), key=lambda e: (abs(shards * e - i * total), e))
        if abs(shards * edge - i * total) * SNAP <= total:
            bounds[i] = (value + (edge > start), 0)
        else:
            inside[i] = (value, start)
    within = {i: (F.col("_a") == value, start) for i, (value, start) in inside.items()}
    for i, (value, start, size) in _refined(keys, within, "_b", total, shards).items():
        edge = min((start, start + size), key=lambda e: (abs(shards * e - i * total), e))
        bounds[i] = (inside[i][0], value + (edge > start))
    return [bounds[i] for i in sorted(bounds)]


def _refined(
    keys: DataFrame, wanted: dict[int, tuple[Column, int]], key: str, total: int, shards: int,
) -> dict[int, tuple[int, int, int]]:
    """For each splitter the value of ``key`` whose rows hold it, the bytes before it and its own bytes.

    ``wanted`` gives the rows to look into and the bytes before them.
    """
    found: dict[int, tuple[int, int, int]] = {}
    open_ = {i: (rows, 0, 0, start) for i, (rows, start) in wanted.items()}  # rows, level, prefix, bytes before
    while open_:
        level = next(iter(open_.values()))[1]
        outer, inner = KEY_BITS - DIGIT_BITS * level, KEY_BITS - DIGIT_BITS * (level + 1)
        marks = {i: rows & (F.shiftright(key, outer) == prefix) for i, (rows, _, prefix, _) in open_.items()}
        counted = (
            keys.filter(reduce(or_, marks.values()))
            .withColumn("_in", F.array(*[F.when(m, F.lit(i)) for i, m in marks.items()]))
            .groupBy("_in", F.shiftright(key, inner).alias("_cell"))
            .agg(F.sum("_size").alias("_bytes"), F.min(key).alias("_low"), F.max(key).alias("_high"))
            .orderBy("_cell").collect()
        )
        for i, (rows, _, _, below) in list(open_.items()):
            cells = [c for c in counted if i in c["_in"]]
            for c in cells:
                if shards * (below + c["_bytes"]) >= i * total or c is cells[-1]:
                    break
                below += c["_bytes"]
            if c["_low"] == c["_high"]:
                found[i] = (c["_low"], below, c["_bytes"])
                del open_[i]
            else:
                open_[i] = (rows, level + 1, c["_cell"], below)
    return found
