"""Enriching texts with a user-supplied callable, in batches and resumably."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType


def enrich_batches(
    rows: DataFrame, text: str, fn: Callable[[list[str]], pd.DataFrame], schema: StructType | str, batch: int = 100,
    dry_run: Callable[[list[str]], pd.DataFrame] | None = None,
) -> DataFrame:
    """Call ``fn`` on lists of at most ``batch`` texts and add its columns (``schema``) in place of ``text``.

    The text does not travel back; join by key where it is needed again.
    With ``dry_run`` that callable runs instead, for placeholder values.
    """
    call = dry_run or fn
    added = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame.pop(text).tolist()
            parts = []
            for at in range(0, len(texts), batch):
                part = texts[at:at + batch]
                parts.append(call(part))
                if len(parts[-1]) != len(part):
                    raise ValueError(f"callable returned {len(parts[-1])} rows for {len(part)} texts")
            if parts:
                yield pd.concat([frame.reset_index(drop=True), pd.concat(parts, ignore_index=True)], axis=1)

    kept = [f for f in rows.schema.fields if f.name != text]
    return rows.mapInPandas(apply, StructType(kept + added.fields))


def with_text_key(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("text_sha", F.sha1(F.coalesce(text, F.lit(""))))


def resume_enrichment(
    rows: DataFrame, key: str, text: str, path: str, fn: Callable[[list[str]], pd.DataFrame], schema: str, batch: int = 100,
) -> DataFrame:
    """Enrich only rows that the table at ``path`` lacks, append them, and return the current results.

    Rows are identified by id and text, so a changed text is done again and stale rows do not match.
    """
    spark = rows.sparkSession
    keyed = with_text_key(rows.select(key, text), text)
    added = StructType.fromDDL(schema)
    stored = StructType([f for f in keyed.schema.fields if f.name != text] + added.fields)
    # An append to a folder without files would otherwise fail to list it.
    spark.createDataFrame([], stored).write.mode("append").parquet(path)
    done = spark.read.schema(stored).parquet(path)
    todo = keyed.join(done.select(key, "text_sha"), [key, "text_sha"], "left_anti")
    enrich_batches(todo, text, fn, added, batch).write.mode("append").parquet(path)
    fresh = spark.read.schema(stored).parquet(path).dropDuplicates([key, "text_sha"])
    return keyed.drop(text).join(fresh, [key, "text_sha"])
