"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: str) -> Column:
    """The text, or the empty string for null."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lost executors then cost one task, not the lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """All rows, or about ``most`` of them by the hash of ``keys``: one count, and nothing is sorted or gathered.

    The same rows come out however the table is partitioned; the limit only binds where rows repeat.
    """
    count = df.count()
    if count <= most:
        return df
    share = int(most / count * (1 << 31))
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 31)) < share).limit(2 * most)


def with_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, renamed so that extra columns cannot clash."""
    return docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
