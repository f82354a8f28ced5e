"""The three searches on benchmark items, put together: hits, reranked texts, their metrics and their context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import text as tx
from textloom.operators import enrich, fusion, irmetrics, keyword, retrieve, vector
from textloom.plans.metric_queries import SQL_QRELS, qrels
from textloom.plans.prep_queries import documents, terms
from textloom.plans.registry import query, r6, table
from textloom.plans.retrieval_queries import corpus, plans, sql_ranked
from textloom.session import cut_lineage

# The data has no vectors of texts. These stand in for a model's: counts of eight letters.
LETTERS = "aeinrstl"


def letter_counts(texts: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"embedding": [[float(t.lower().count(c)) for c in LETTERS] for t in texts]})


def _embedded(rows: DataFrame, text: str) -> DataFrame:
    return enrich.enrich_batches(rows, text, letter_counts, "embedding array<double>")


def _lines(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.posexplode(F.split("text", "\n")).alias("token_id", "line"))


SQL_VECTOR = "[" + ", ".join(f"(length(t) - length(replace(t, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"
SQL_COS = "CASE WHEN list_sum(q.v) = 0 OR list_sum(d.v) = 0 THEN 0 ELSE list_cosine_similarity(q.v, d.v) END"
SQL_FOUND = f"""{sql_ranked()},
dv AS (SELECT doc_id, {SQL_VECTOR} AS v FROM (SELECT doc_id, lower(text) AS t FROM documents)),
qv AS (SELECT item_id AS query_id, {SQL_VECTOR} AS v FROM (SELECT item_id, lower(text) AS t FROM benchmark)),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM
  (SELECT query_id, doc_id, {SQL_COS} AS score FROM qv AS q, dv AS d)) WHERE rank <= 5),
dl AS (SELECT doc_id, {SQL_VECTOR} AS v FROM (SELECT doc_id, lower(unnest(string_split(text, chr(10)))) AS t FROM documents)),
ql AS (SELECT query_id, i, {SQL_VECTOR} AS v FROM (SELECT item_id AS query_id, unnest(range(len(string_split(text, chr(10))))) AS i,
  lower(unnest(string_split(text, chr(10)))) AS t FROM benchmark)),
late AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM
  (SELECT query_id, doc_id, sum(best) AS score FROM (SELECT query_id, i, doc_id, max({SQL_COS}) AS best FROM ql AS q, dl AS d GROUP BY ALL) GROUP BY ALL)) WHERE rank <= 5),
hits3 AS (SELECT query_id, chunk_id AS doc_id, 'Keyword' AS search_type, rank, score, 0 AS ord FROM ranked
  UNION ALL SELECT query_id, doc_id, 'Semantic', rank, score, 1 FROM vec UNION ALL SELECT query_id, doc_id, 'ColBERT', rank, score, 2 FROM late)"""
SQL_BEST = f"""{SQL_FOUND},
kept3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY ord, rank) AS keep FROM hits3) WHERE keep = 1),
best3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, 'Text #: ' || doc_id) AS place FROM
  (SELECT *, ((doc_id * 37 + query_id * 11) % 101) / 101.0 AS relevance FROM kept3)) WHERE place <= 8)"""


def found_hits(spark: SparkSession, d: str) -> list[DataFrame]:
    docs = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    by_word = keyword.keyword_search(corpus(spark, d), terms(spark, d), plans(spark, d), 5)
    by_vector = vector.cosine_top(_embedded(docs, "text"), _embedded(asked, "text"), 5)
    # Stored once, as the late interaction reads them three times.
    lines = cut_lineage(_embedded(_lines(docs, "chunk_id"), "line").select("chunk_id", "embedding"), "line-vectors")
    late = vector.late_interaction_top(lines, _embedded(_lines(asked, "query_id"), "line"), 5)
    return [retrieve.keyword_hits(by_word), retrieve.vector_hits(by_vector), retrieve.late_interaction_hits(late)]


def _relevance(documents_: DataFrame) -> DataFrame:
    """Relevance in [0, 1) from the text number, in place of an external model."""
    n = tx.id_number(F.col("text_id"))
    return documents_.select("query_id", "text_id").distinct().withColumn("relevance", ((n * 37 + F.col("query_id") * 11) % 101) / 101.0)


def best_texts(spark: SparkSession, d: str) -> DataFrame:
    known = documents(spark, d).select(F.col("doc_id").alias("text_id"), "source", F.col("text").alias("full_text"))
    return retrieve.retrieve(found_hits(spark, d), known, _relevance, 8)


@query("q_pipeline_hits", f"""WITH {SQL_FOUND}
SELECT query_id, 'Text #: ' || doc_id AS text_id, search_type, rank, round(score + 1e-9, 6) AS score FROM hits3""")
def q_hits(spark, d):
    return fusion.union_hits(*found_hits(spark, d)).select("query_id", "text_id", "search_type", "rank", r6("score").alias("score"))


@query("q_pipeline_ranked", f"""WITH {SQL_BEST}
SELECT b.query_id, b.place AS rank, b.search_type, 'Text #: ' || b.doc_id AS text_id, d.source, md5(d.text) AS text_md5, round(b.relevance + 1e-9, 6) AS relevance
FROM best3 b JOIN documents d USING (doc_id)""")
def q_ranked(spark, d):
    return best_texts(spark, d).select(
        "query_id", "rank", "search_type", "text_id", "source", F.md5("full_text").alias("text_md5"), r6("relevance").alias("relevance")
    )


@query("q_pipeline_metrics", f"""WITH {SQL_BEST}, {SQL_QRELS},
r AS (SELECT b.query_id, count(*) AS n, count(q.chunk_id) AS hit FROM best3 b LEFT JOIN qrels q ON q.query_id = b.query_id AND q.chunk_id = b.doc_id GROUP BY 1),
s AS (SELECT query_id, count(*) AS ideal FROM qrels GROUP BY 1)
SELECT query_id, coalesce(hit, 0) AS n_hit, coalesce(ideal, 0) AS n_ideal, round(CASE WHEN n > 0 THEN hit / n ELSE 0 END, 4) AS precision,
 round(CASE WHEN coalesce(ideal, 0) > 0 THEN coalesce(hit, 0) / ideal ELSE 0 END, 4) AS recall FROM r FULL JOIN s USING (query_id)""")
def q_metrics(spark, d):
    ranked = best_texts(spark, d).select("query_id", tx.id_number(F.col("text_id")).alias("chunk_id"), "rank")
    return irmetrics.precision_recall(ranked, qrels(spark, d)).select("query_id", "n_hit", "n_ideal", "precision", "recall")
