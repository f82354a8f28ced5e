"""Exact deduplication by content sort. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.llm.common import ascii_lower, whole

PREFIX = 48  # leading characters of a range key
HOT_PARTS = 1000
SALTS = 64
ROW_BYTES = 64


def mark_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=ascii_lower,
) -> DataFrame:
    """Every row of ``docs`` as ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalised bytes are equal. Rows are range-partitioned at sampled
    splitters on (first characters, digest, salt) and sorted externally; equal texts are then
    neighbours, and the window over the sorted run compares neighbours on all their bytes. The
    splitters hold a bounded prefix and a digest, so the sample stays small however long texts are.

    A text that holds 1/1000 of all bytes or more (at most 1000 texts do) is spread over ``SALTS``
    runs by its identifier. Its size and retained identifier come from an aggregate over digests
    that combines on the map side.

    Null texts count as empty. Null identifiers lose against any other. Of rows that repeat text
    and identifier one stays. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalise(whole(text_col)).alias("_norm"))
    rows = rows.withColumn("_sha", F.sha2("_norm", 256))
    run = Window.partitionBy("_start", "_sha", "_salt", "_norm")
    ranked = _exchanged(rows, keep).select(
        "_id", "_sha", "_hot_keep", "_hot_size",
        F.row_number().over(run.orderBy(*_order(keep))).alias("_n"),
        _best(keep).over(run).alias("_keep"), F.count("*").over(run).alias("_size"),
    )
    hot = F.col("_hot_size").isNotNull()
    return ranked.select(
        F.col("_id").alias(id_col),
        F.when(hot, F.col("_hot_keep")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_hot_size", "_size").alias("group_size"), _stays().alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=ascii_lower,
) -> DataFrame:
    """One row of ``docs`` per distinct text, all columns unchanged; rules as in ``mark_copies``."""
    rows = docs.select(
        F.col(id_col).alias("_id"), normalise(whole(text_col)).alias("_norm"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
    ).withColumn("_sha", F.sha2("_norm", 256))
    # The normal form is built again after the exchange, so that a text travels once.
    again = normalise(F.coalesce(F.col("_row").getField(text_col).cast("string"), F.lit("")))
    run = Window.partitionBy("_start", "_sha", "_salt", "_norm").orderBy(*_order(keep))
    ranked = _exchanged(rows, keep, carried="_row").withColumn("_norm", again).withColumn("_n", F.row_number().over(run))
    return ranked.filter(_stays()).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def _order(keep: str) -> list[Column]:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    c = F.col("_id")
    return [c.asc_nulls_last() if keep == "smallest" else c.desc_nulls_last()]


def _best(keep: str) -> Column:
    return F.min("_id") if keep == "smallest" else F.max("_id")


def _stays() -> Column:
    """The first row of its run; of a hot text, only that of the run with the retained identifier."""
    return (F.col("_n") == 1) & (F.col("_hot_size").isNull() | F.col("_id").eqNullSafe(F.col("_hot_keep")))


def _exchanged(rows: DataFrame, keep: str, carried: str = "_norm") -> DataFrame:
    """Rows range-partitioned on keys that every window above names, so that no further exchange follows."""
    weight = F.octet_length("_norm").cast("double") + F.lit(ROW_BYTES)
    total = rows.agg(F.sum(weight)).scalar()
    hot = (
        rows.groupBy("_sha").agg(F.sum(weight).alias("_w"), F.count("*").alias("_hot_size"), _best(keep).alias("_hot_keep"))
        .filter((F.col("_hot_size") > 1) & (F.col("_w") * HOT_PARTS >= total)).drop("_w")
    )
    keyed = rows.withColumn("_start", F.substring("_norm", 1, PREFIX)).select("_id", "_sha", "_start", carried)
    salt = F.when(F.col("_hot_size").isNotNull(), F.pmod(F.xxhash64("_id"), F.lit(SALTS))).otherwise(0)
    return keyed.join(F.broadcast(hot), "_sha", "left").withColumn("_salt", salt).repartitionByRange("_start", "_sha", "_salt")
