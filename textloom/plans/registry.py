"""Named queries over the driver tables, each with an equivalent DuckDB statement where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# A table of fewer bytes than this is one file with one row group, which no setting can split.
SMALL_TABLE = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Only one of a few megabytes is dealt over the cores; larger ones are scanned as they lie."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL_TABLE else df


def r6(c) -> F.Column:
    """Six digits; a nudge keeps sums of another order from splitting exact halves."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


# ---- SQL pieces --------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]+"
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def sql_squeeze(e: str) -> str:
    return sql_strip(f"regexp_replace({e}, '{WS}+', ' ', 'g')")


def sql_words(e: str) -> str:
    """White-space separated words."""
    return f"list_filter(regexp_split_to_array({e}, '{WS}+'), lambda w: w <> '')"


def sql_runs(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '{WORD}')"


SQL_SHORT = "Mr|Mrs|Dr|Prof|Gov|Gen|Col|Lt|Sgt|Hon|Rev|Jr|Sr|St|Vol|No|vs|etc|viz|cf|approx"


def sql_sentences(e: str) -> str:
    kept = rf"regexp_replace({e}, '(^|[^\p{{L}}\p{{N}}_])({SQL_SHORT})\.', '\1\2' || chr(2), 'g')"
    cut = rf"regexp_replace({kept}, '([.!?]){WS}+([A-Z])', '\1' || chr(1) || '\2', 'g')"
    parts = f"string_split(replace({cut}, chr(2), '.'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: {sql_strip('s')}), lambda s: s <> '')"
