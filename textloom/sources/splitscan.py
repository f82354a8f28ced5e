"""Scans that cut single large files into byte ranges and put the pieces together again.

Spark's text source reads a file in byte ranges at any separator and never breaks a character. The
rows of a range keep their order and carry its place, so a value that depends on all that lies before
(inside a string or not, how many brackets are open) needs one small row per range: what the range
changes, whichever way it is entered. A running sum over these rows gives every range its start, and
the ranges are then read independently.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textloom.operators.skew import broadcast_if_small
from textloom.session import cut_lineage

LIST_HEAD = r"^\s*\["
DATA_HEAD = r'^\s*\{\s*"data"\s*:\s*\['
NO_CORPUS = "neither a list of records nor a data list"
WHOLE, HEAD, THROUGH, TAIL = 0, 1, 2, 3


def _fragments(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """``value, path, start, size`` in the order of the file; ``start`` is the first byte of the range a task reads."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
    )


def _with_brackets(rows: DataFrame) -> DataFrame:
    """What a fragment and the brace behind it change: ``flips`` the state of being in a string, ``out`` and ``ins`` the depth.

    ``out`` holds if the fragment begins outside a string, ``ins`` if inside. JSON has backslashes in
    strings only, each with the character it escapes.
    """
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    opened = lambda s: F.length(F.translate(s, "}]", "")) - F.length(F.translate(s, "{[", ""))
    total = lambda odd: F.aggregate(
        F.filter(F.transform("_p", lambda s, i: F.when(i % 2 == odd, opened(s))), lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d,
    )
    cut = rows.withColumn("_p", parts)
    flips = (F.size("_p") - 1) % 2
    return cut.select(
        "path", "start", "value", "size", flips.alias("flips"), (total(0) - F.when(flips == 0, 1).otherwise(0)).alias("out"),
        (total(1) - F.when(flips == 1, 1).otherwise(0)).alias("ins"),
    )


def read_json_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``record``: the JSON text of every object in files that hold one list each, or ``{"data": [...]}``.

    A file is read in as many tasks as its size has ranges, two times; only objects that cross from
    one range to the next are exchanged. Objects may hold any nesting and any characters. What is no
    list of objects, a file that ends early, or keys before or objects after a data list raise an
    error. An empty list, and a file without a byte, has no records. The order is not kept.
    """
    rows = _with_brackets(_fragments(spark, path, "}"))
    sums = cut_lineage(
        rows.withColumn("kind", F.when(F.regexp_like("value", F.lit(LIST_HEAD)), 1).when(F.regexp_like("value", F.lit(DATA_HEAD)), 2))
        .select("path", "start", "flips", "out", "ins", "kind", "size", (F.octet_length("value").cast("long") + 1).alias("bytes"))
        .mapInArrow(_summed, "path string, start bigint, flips int, d0 bigint, d1 bigint, bytes bigint, size bigint, kind int"),
        "ranges",
    )
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    whole_file = Window.partitionBy("path")
    entered = sums.withColumn("inside", F.coalesce(F.sum("flips").over(before) % 2, F.lit(0)).cast("int")).withColumn(
        "depth", F.coalesce(F.sum(F.when(F.col("inside") == 1, F.col("d1")).otherwise(F.col("d0"))).over(before), F.lit(0))
    )
    known = entered.withColumn("level", F.max(F.when(F.col("start") == 0, F.col("kind"))).over(whole_file))
    # One byte too many is a brace that the file does not end with; a mark of three bytes may be missing at its start.
    loose = (F.sum("bytes").over(whole_file) - F.col("size") + 3) % 3 == 1
    states = known.withColumn("loose", loose).select(
        "path", "start", "inside", "depth", "loose", F.coalesce("level", F.raise_error(F.lit(NO_CORPUS)).cast("int")).alias("level"),
    )
    states = cut_lineage(states, "range-states")
    pieces = rows.join(broadcast_if_small(states.drop("loose")), ["path", "start"])
    pieces = pieces.select("path", "start", "value", "flips", "out", "ins", "inside", "depth", "level").mapInArrow(
        _cut, "path string, start bigint, level int, part int, text string",
    )
    pieces = cut_lineage(pieces, "records")
    crossing = pieces.filter(F.col("part") != WHOLE)
    order = Window.partitionBy("path").orderBy("start", "part")  # two narrow rows per range
    begun = F.max(F.when(F.col("part") == TAIL, F.col("start"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    owner = crossing.select("path", "start", "part").withColumn("_first", begun)
    joined = crossing.join(owner, ["path", "start", "part"]).groupBy("path", "_first").agg(
        F.max("level").alias("level"), F.max(F.when(F.col("part") == HEAD, 1).otherwise(0)).alias("closed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "").alias("text"),
    )
    files = states.groupBy("path").agg(F.first("loose").alias("loose"))
    joined = joined.join(broadcast_if_small(files), "path").withColumn(
        "text", F.when((F.col("closed") == 0) & F.col("loose"), F.left("text", F.length("text") - 1)).otherwise(F.col("text")),
    )
    # what follows the last record closes the list, and with it the file
    end = F.when(F.col("level") == 1, F.regexp_like("text", F.lit(r"(?s)^\s*\]\s*$"))).otherwise(
        F.regexp_like("text", F.lit(r"(?s)^\s*\]\s*(,[^{}]*)?\}\s*$"))
    )
    checked = F.when(F.col("closed") == 1, F.col("text")).when(~end, F.raise_error(F.lit(f"{NO_CORPUS}, or a file that ends early")))
    texts = pieces.filter(F.col("part") == WHOLE).select("text").unionByName(
        joined.select(checked.alias("text")).filter("text is not null")
    )
    record = F.regexp_extract("text", r"(?s)^\s*,?\s*(\{.*)$", 1)
    return texts.select(F.when(record == "", F.raise_error(F.lit(NO_CORPUS))).otherwise(record).alias("record"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, str, int]]:
    """Parts of the batches that lie in one range, with its file and place."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column("start").to_numpy()
        files = batch.column("path").dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(starts) != 0) | (np.diff(files) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a), batch.column("path")[a].as_py(), int(starts[a])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "start", "flips", "d0", "d1", "bytes", "size", "kind"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    found: dict[tuple[str, int], list] = {}
    for part, path, start in _runs(batches):
        known = found.setdefault((path, start), [0, 0, 0, 0, part.column("size")[0].as_py(), part.column("kind")[0].as_py()])
        flips, out, ins = (part.column(c).to_numpy().astype(np.int64) for c in ("flips", "out", "ins"))
        inside = (known[0] + np.cumsum(flips) - flips) % 2
        known[1] += int(np.where(inside, ins, out).sum())
        known[2] += int(np.where(inside, out, ins).sum())
        known[3] += int(part.column("bytes").to_numpy().sum())
        known[0] = int((known[0] + flips.sum()) % 2)
    rows = [(path, start, *values) for (path, start), values in found.items()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that lie in one range, and of each range what stands before the first end of a record and after the last."""
    names = ["path", "start", "level", "part", "text"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    at, inside, depth, level, pending, ended = None, 0, 0, 0, [], False

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    def rest() -> tuple:
        return (*at, level, TAIL if ended or at[1] == 0 else THROUGH, "".join(pending))

    for part, path, start in _runs(batches):
        out = []
        values = part.column("value").to_pylist()
        if (path, start) != at:
            if at is not None:
                out.append(rest())
            at, pending, ended = (path, start), [], False
            inside, depth, level = (int(part.column(c)[0].as_py()) for c in ("inside", "depth", "level"))
            if start == 0:
                values[0] = re.sub(LIST_HEAD if level == 1 else DATA_HEAD, "", values[0], count=1)
        flips, outer, inner = (part.column(c).to_numpy().astype(np.int64) for c in ("flips", "out", "ins"))
        state = (inside + np.cumsum(flips) - flips) % 2
        depths = depth + np.cumsum(np.where(state, inner, outer))
        inside, depth = int((inside + flips.sum()) % 2), int(depths[-1])
        ends = ((state + flips) % 2 == 0) & (depths == level)
        for value, end in zip(values, ends.tolist(), strict=True):
            pending += [value, "}"]
            if end:
                out.append((path, start, level, WHOLE if ended or start == 0 else HEAD, "".join(pending)))
                pending, ended = [], True
        yield batch_of(out)
    if at is not None:
        yield batch_of([rest()])


def write_json_lists(df: DataFrame, path: str) -> None:
    """Every part file one JSON list of the rows. A partition without rows writes an empty list."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            lines = []
            for record in batch.column("record").to_pylist():
                lines.append(lead + record)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], ["value"])

    df.select(F.to_json(F.struct("*")).alias("record")).mapInArrow(listed, "value string").write.text(path)


def read_text_ranges(
    spark: SparkSession, paths: str | list[str], manifest: DataFrame, range_bytes: int = 16 * 1024 * 1024, separator: str = "\n",
) -> DataFrame:
    """Text files of any size as rows of about ``range_bytes``: ``position, label, file_name, block, part, text``.

    Files have the labels of ``manifest(file_name, position, label)``; a file of the manifest that is
    missing or empty has one row without a text. A row holds whole lines, or whatever ``separator``
    ends; only a longer line makes a longer row. The rows of a file in the order of ``block, part``,
    joined by the separator, are the file without a separator at its end. Bytes that are no UTF-8
    become replacement characters.
    """
    rows = _fragments(spark, paths, separator).withColumn("value", F.make_valid_utf8("value"))
    types = [pa.string(), pa.int64(), pa.int32(), pa.string()]
    names = ["path", "block", "part", "text"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part_no, held, size = None, 0, [], 0

        def row() -> pa.RecordBatch:
            values = [at[0], at[1], part_no, separator.join(held)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for part, path, start in _runs(batches):
            if (path, start) != at:
                if held:
                    yield row()
                at, part_no, held, size = (path, start), 0, [], 0
            for value in part.column("value").to_pylist():
                if held and size + len(value) > range_bytes:
                    yield row()
                    part_no, held, size = part_no + 1, [], 0
                held.append(value)
                size += len(value) + 1
        if held:
            yield row()

    ranges = rows.mapInArrow(packed, "path string, block bigint, part int, text string").withColumn(
        "file_name", F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    )
    # The manifest goes to where the ranges are, so that no file comes together in one task.
    present = spark.read.format("binaryFile").load(paths).filter("length > 0").select(
        F.element_at(F.split("path", "/"), -1).alias("file_name")
    )
    found = ranges.drop("path").join(broadcast_if_small(manifest), "file_name")
    absent = manifest.join(present, "file_name", "left_anti")
    return found.unionByName(absent, allowMissingColumns=True).select("position", "label", "file_name", "block", "part", "text")
