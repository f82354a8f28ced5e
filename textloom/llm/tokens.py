"""Token ids in Parquet: a list column with a dictionary, small row groups and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textloom.llm.arrow import slices
from textloom.llm.bpe import ENCODED_BYTES, encoder
from textloom.llm.common import with_ids

ROW_GROUP_BYTES = 16 * 1024 * 1024
PAGE_ROWS = 256
FORMAT = {
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),  # the column index then finds a document by few pages
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding for what has no dictionary
    "parquet.dictionary.page.size": str(1024 * 1024),
}


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every text, append ``end_id`` and write ``id_col, n_tokens, ids`` in ascending identifiers.

    Documents are exchanged by range of the identifier before they are encoded, so that part file n
    holds smaller identifiers than part file n + 1, and sorted inside. Row groups are about 16 MB,
    pages at most 256 documents with minima and maxima in the page index.

    Null texts count as empty and give the end id alone. Null identifiers come first. Rows that
    repeat an identifier are all written, in the order of their texts. An empty table gives files
    without rows. Other columns are not read. Texts are encoded whole, however long.
    """
    rows = with_ids(docs, id_col, text_col).repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in slices(batches, "_text", ENCODED_BYTES):
            ids, ends = enc.encode_all(part.column("_text"), (end_id,))
            ends = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.view("<i4")))],
                ["_id", "n_tokens", "ids"],
            )

    out = rows.mapInArrow(encode, f"_id {kind}, n_tokens int, ids array<int>").withColumnRenamed("_id", id_col)
    out.write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str, with_crc: bool = False) -> DataFrame:
    """The files of ``write_tokens`` as ``id_col, start, n_tokens``; ``start`` counts the ids of all documents before.

    Only the metadata columns are read. ``with_crc`` reads the ids too and adds ``ids_crc32`` over
    their little-endian 32-bit form. Sums run inside each part file; what the files before hold comes
    from one row per file. For the ids of some documents filter ``spark.read.parquet(path)`` by
    identifier: the page index skips the other pages.
    """
    files = spark.read.parquet(path)
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    rows = files.withColumns({"_file": number, "_at": F.col("_metadata.row_index")})
    sums = files.select(number.alias("_file"), "n_tokens").groupBy("_file").agg(F.sum("n_tokens").alias("_n"))
    rows = _checksums(rows) if with_crc else rows.drop("ids")
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = sums.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = local.join(offsets, "_file").withColumn("start", F.col("_offset") + F.col("_inside"))
    return placed.drop("_file", "_at", "_inside", "_offset")


def _checksums(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c != "ids"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others) + ", ids_crc32 bigint"

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(sums, pa.int64())], [*others, "ids_crc32"],
            )

    return rows.mapInArrow(crc, schema)
