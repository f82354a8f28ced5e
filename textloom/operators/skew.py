"""Joins and top-k that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.session import BROADCAST_LIMIT


ROW_OVERHEAD = 32


def table_bytes(df: DataFrame) -> int:
    """Measured size of a table: its rows as JSON and an overhead each, summed where the rows are."""
    size = F.octet_length(F.to_json(F.struct("*"))) + ROW_OVERHEAD
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Mark ``df`` for broadcasting only if its measured size stays below ``limit`` bytes.

    Meant for query-side tables, whose size is cheap next to a corpus scan. The result of a join
    is the same either way.
    """
    return F.broadcast(df) if table_bytes(df) <= limit else df


def keep_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is in ``ids``: a scan-side filter before a wide table enters a shuffle."""
    return df.join(broadcast_if_small(ids.select(key).distinct()), key, "left_semi")


def heavy_keys(counts: DataFrame, key: str, n: str, parts: int = 1000) -> DataFrame:
    """Keys holding at least 1/parts of all rows: at most ``parts`` of them, so safe to broadcast."""
    total = counts.select(F.sum(n)).scalar()
    return counts.filter(F.col(n) * parts >= total).select(key)


def salted_join(
    many: DataFrame, few: DataFrame, key: str, heavy: DataFrame, spread: Column, salts: int = 64,
    how: str = "inner",
) -> DataFrame:
    """Join on ``key``; rows of a heavy key are spread over ``salts`` tasks by ``spread``.

    ``few`` is repeated per salt for heavy keys only. ``heavy`` comes from ``heavy_keys``.
    """
    hot = F.broadcast(heavy.select(key, F.lit(True).alias("_hot")))
    left = (
        many.join(hot, key, "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)))
        .drop("_hot")
    )
    every = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    right = (
        few.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0).cast("long")))))
        .drop("_hot")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Spark cuts each map task to ``n`` rows per key before shuffling."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n).withColumn(
        rank, F.col(rank).cast("long")
    )
