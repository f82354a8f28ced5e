"""Append-only logs and stored evaluation results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from textloom import schemas


def stamp(df: DataFrame) -> DataFrame:
    now = F.current_timestamp()
    return df.withColumn("logged_at", now).withColumn("log_date", F.to_date(now))


def append_log(df: DataFrame, path: str) -> None:
    """Append rows with the time of writing, in folders by date."""
    stamp(df).write.mode("append").partitionBy("log_date").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, logged_at timestamp, log_date date").parquet(path)


def _json(c: Column) -> Column:
    return F.to_json(c)


def keyword_log_rows(hits: DataFrame, plans: DataFrame) -> DataFrame:
    """One log row per keyword hit; maps and lists as JSON."""
    p = plans.select(
        "query_id", F.col("query").alias("user_query"), "initial_answer", _json(F.col("weighted_keywords")).alias("weighted_keywords"),
        _json(F.col("year_keywords")).alias("year_keywords"), _json(F.col("text_keywords")).alias("text_keywords"),
    )
    return hits.join(p, "query_id").select(
        "user_query", "initial_answer", "weighted_keywords", "year_keywords", "text_keywords",
        F.concat(F.lit("Text #: "), F.col("chunk_id")).alias("text_id"),
        F.coalesce("quote", F.lit("No key quote available.")).alias("key_quote"),
        F.col("score").alias("weighted_score"), _json(F.col("keyword_counts")).alias("keyword_counts"),
    )


def vector_log_rows(hits: DataFrame, queries: DataFrame) -> DataFrame:
    q = queries.select("query_id", F.col("query").alias("user_query"), F.coalesce("initial_answer", F.lit("")).alias("hyde_query"))
    segment = F.coalesce("top_segment", F.lit("")) if "top_segment" in hits.columns else F.lit("")
    return hits.join(q, "query_id").select(
        "user_query", "hyde_query", F.concat(F.lit("Text #: "), F.col("chunk_id")).alias("text_id"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"), segment.alias("top_segment"),
    )


def rerank_log_rows(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    q = queries.select("query_id", F.col("query").alias("user_query"))
    return ranked.join(q, "query_id").select(
        "user_query", "rank", "search_type", "text_id", F.col("full_text").alias("key_quote"),
        F.coalesce("relevance", F.lit(0.0)).alias("relevance"),
    )


def answer_log_rows(answers: DataFrame, answer_json: str) -> DataFrame:
    """Flattened answer document. ``answers``: user_query, initial_answer and the JSON column."""
    j = F.col(answer_json)

    def at(path: str, default: str = "") -> Column:
        return F.coalesce(F.get_json_object(j, path), F.lit(default))

    refs = F.from_json(F.get_json_object(j, "$.FinalAnswer.References"), "array<string>")
    return answers.select(
        "user_query", "initial_answer", at("$.FinalAnswer.Text", "No response available").alias("final_answer"),
        F.coalesce(F.array_join(refs, ", "), F.lit("")).alias("references"),
        at("$['User Query Analysis']['Query Intent']").alias("query_intent"),
        at("$['User Query Analysis']['Historical Context']").alias("historical_context"),
        at("$['Initial Answer Review']['Answer Evaluation']").alias("answer_evaluation"),
        at("$['Initial Answer Review']['Quote Integration Points']").alias("quote_integration"),
        *[at(f"$['Match Analysis']['RerankedMatch{i}']", "{}").alias(f"match_{i}") for i in (1, 2, 3)],
        at("$['Meta Analysis']", "{}").alias("meta_analysis"), at("$['Meta Analysis'].Synthesis").alias("synthesis"),
        at("$['Model Feedback']['Response Effectiveness']").alias("response_effectiveness"),
        at("$['Model Feedback']['Suggestions for Improvement']").alias("suggestions"),
    )


def benchmark_log_rows(queries: DataFrame, overlap: DataFrame, metrics: DataFrame, judged: DataFrame, matched: DataFrame) -> DataFrame:
    """One row per query from the score tables, 0 where a table has none."""
    out = queries
    for part in (overlap, metrics, judged, matched):
        out = out.join(part, "query_id", "left")
    numbers = [f.name for f in out.schema.fields if f.dataType.typeName() in ("double", "long", "integer") and f.name != "query_id"]
    return out.fillna(0, numbers)


def check_layout(spark: SparkSession, path: str, schema: str) -> bool:
    """True if a result table exists at ``path``; raises if its columns differ in name or order."""
    if not _exists(spark, path):
        return False
    have, want = spark.read.parquet(path).schema, StructType.fromDDL(schema)
    if [(f.name, f.dataType) for f in have] != [(f.name, f.dataType) for f in want]:
        raise ValueError(f"layout of {path} is {have.fieldNames()}, expected {want.fieldNames()}")
    return True


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def as_layout(df: DataFrame, schema: str) -> DataFrame:
    """Exactly the columns of the layout, in its order; fails on a missing or extra column."""
    want = StructType.fromDDL(schema)
    missing, extra = set(want.fieldNames()) - set(df.columns), set(df.columns) - set(want.fieldNames())
    if missing or extra:
        raise ValueError(f"missing columns {sorted(missing)}, unknown columns {sorted(extra)}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want])


def append_results(df: DataFrame, path: str, schema: str = schemas.RESULT) -> None:
    check_layout(df.sparkSession, path, schema)
    as_layout(df, schema).write.mode("append").parquet(path)


def update_results(stored: DataFrame, updates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows with the supplied columns replaced, and the updates that match no row.

    A null in ``updates`` leaves the stored value as it is. Two updates of one key raise an error.
    """
    cols = [c for c in updates.columns if c != key]
    twice = F.raise_error(F.concat(F.lit("several updates of "), F.col(key).cast("string")))
    once = updates.groupBy(key).agg(F.count("*").alias("_n"), *[F.any_value(c).alias(f"_new_{c}") for c in cols])
    new = once.select(key, *[F.when(F.col("_n") > 1, twice).otherwise(F.col(f"_new_{c}")).alias(f"_new_{c}") for c in cols])
    joined = stored.join(new, key, "left")
    merged = joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in stored.columns])
    return merged, updates.join(stored.select(key), key, "left_anti")
