"""Global sequence numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def running_offsets(df: DataFrame, key: str, n: str, fan: int = 4096, levels: int = 2) -> DataFrame:
    """``key, offset``: sum of ``n`` over all smaller keys.

    ``key`` is a unique integer (fairly dense, such as a row number of the source). Keys are
    grouped into blocks of ``fan``; block sums are added up the same way one level higher, so
    no window holds more than ``fan`` rows below the top level.
    """
    if levels == 0:
        before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(key, F.coalesce(F.sum(n).over(before), F.lit(0)).alias("offset"))
    block, inner = f"_block{levels}", f"_inner{levels}"
    rows = df.select(key, n, F.floor(F.col(key) / fan).cast("long").alias(block))
    sums = rows.groupBy(block).agg(F.sum(n).alias("_n"))
    above = running_offsets(sums, block, "_n", fan, levels - 1).withColumnRenamed("offset", "_base")
    before = Window.partitionBy(block).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn(inner, F.coalesce(F.sum(n).over(before), F.lit(0)))
    return within.join(above, block).select(key, (F.col("_base") + F.col(inner)).alias("offset"))


def with_neighbours(
    df: DataFrame, group: str, position: str, value: str, reach: int, out: str, block: int = 4096
) -> DataFrame:
    """Array of ``value`` from ``position - reach`` to ``position + reach`` within ``group``.

    Rows near a block edge are copied into the next block, so that a window covers at most
    ``block + 2 * reach`` positions however long one group is.
    """
    pos = F.col(position)
    first, last = F.floor((pos - reach) / block), F.floor((pos + reach) / block)
    own = F.floor(pos / block)
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(group, "_block").orderBy(position).rangeBetween(-reach, reach)
    return (
        spread.withColumn(out, F.collect_list(value).over(w))
        .filter(F.col("_own") == F.col("_block"))
        .drop("_own", "_block")
    )
