"""Registered queries: sources and sinks, each a round trip of a driver table through files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.operators import vector
from textloom.plans.eval_queries import SQL_RUNS, runs
from textloom.plans.output_queries import SQL_ASSISTANT, answer_documents
from textloom.plans.prep_queries import SQL_TERMS, documents, terms
from textloom.plans.registry import query, r6, table
from textloom.plans.retrieval_queries import (
    SQL_CENTROIDS, SQL_RERANKED, centroids, hits, plans, reranked, sql_ranked,
)
from textloom.session import scratch_path
from textloom.sources import files, results, splitscan


FILE_BYTES = 16 * 1024 * 1024  # of text in a file that is read as one row


def records(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the corpus layout."""
    return documents(spark, d).select(
        F.concat(F.lit("Text #: "), F.col("doc_id")).alias("text_id"), "source", F.col("text").alias("full_text"), F.lit("s").alias("summary"),
        F.array("lang", "source").alias("keywords"), F.lit("").alias("keywords_semantic"), F.lit("c").alias("chunk_context"),
        F.col("doc_id").alias("position"), F.col("n_chars").alias("total_in_source"), F.col("doc_id").cast("string").alias("source_file"), F.col("lang").alias("source_type"),
    )


SQL_RECORDS = "SELECT 'Text #: ' || doc_id AS text_id, source, text AS full_text, lang || '|' || source AS keywords, doc_id AS position FROM documents"


def _short(df: DataFrame) -> DataFrame:
    return df.select("text_id", "source", "full_text", F.array_join("keywords", "|").alias("keywords"), "position")


@query("s1_corpus_json_scan", SQL_RECORDS)
def s1(spark, d):
    path = scratch_path(spark, "wrapped")
    rows = records(spark, d)
    rows.select(F.array(F.struct(*rows.columns)).alias("data")).write.json(path)
    return _short(files.read_corpus_json(spark, path, lines=True))


@query("s1_json_list_scan", SQL_RECORDS)
def s1_list(spark, d):
    """The documents as files that hold one JSON list each, read in byte ranges."""
    path = scratch_path(spark, "lists")
    splitscan.write_json_lists(records(spark, d), path)
    return _short(files.read_corpus_json(spark, path))


@query("s2_embedding_index_scan", """
SELECT 'Text #: ' || vec_id AS text_id, 'body ' || label AS full_text, CAST(len(embedding) AS BIGINT) AS dimension FROM embeddings""")
def s2(spark, d):
    path = scratch_path(spark, "index")
    combined = F.concat(F.lit("Text #: "), F.col("vec_id"), F.lit("\nFull Text:\nbody "), F.col("label"), F.lit("\n Summary: s"))
    table(spark, d, "embeddings").select(combined.alias("combined"), F.to_json("embedding").alias("embedding")).write.parquet(path)
    index = files.read_embedding_index(spark, path)
    return index.select("text_id", "full_text", F.size("embedding").cast("long").alias("dimension"))


@query("s3_term_table_scan", f"WITH {SQL_TERMS} SELECT term, raw_freq, doc_freq FROM terms")
def s3(spark, d):
    path = scratch_path(spark, "terms")
    one = F.struct(F.col("term"), F.col("raw_freq").alias("rawFreq"), F.col("doc_freq").alias("inDocumentsCount"))
    doc = F.struct(F.col("raw_freq").alias("total"), F.array(one).alias("terms"))
    # Half of the documents hold the object itself, half a JSON string of it.
    as_text = F.to_json(F.struct(F.to_json(doc).alias("corpusTerms")))
    as_object = F.to_json(F.struct(doc.alias("corpusTerms")))
    terms(spark, d).select(F.when(F.col("raw_freq") % 2 == 0, as_text).otherwise(as_object).alias("value")).write.text(path)
    return files.read_term_table(spark, path)


@query("s4_jsonl_scan_and_sink", """
SELECT role || ':' || text AS messages, CAST(NULL AS VARCHAR) AS meta FROM conversations""")
def s4(spark, d):
    path = scratch_path(spark, "jsonl")
    message = F.struct(F.col("role"), F.col("text").alias("content"))
    rows = table(spark, d, "conversations").select(
        F.array(message).alias("messages"), F.struct(F.lit("t").alias("task"), F.lit("s").alias("section")).alias("_meta")
    )
    files.write_jsonl(rows, path)
    back = files.read_jsonl(spark, path)
    return back.select(
        F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("messages"),
        F.to_json("_meta").alias("meta"),
    )


@query("s5_multi_run_csv_scan", f"""WITH {SQL_RUNS}
SELECT 'q' || query_id AS QueryID, CAST(run - 1 AS BIGINT) AS run, round(FA + 1e-9, 6) AS FA, round(hi - lo + 1e-9, 6) AS Rerank, round(total + 1e-9, 6) AS RubricTotal,
       'missing' AS errors FROM tot""")
def s5(spark, d):
    base = scratch_path(spark, "runs")
    rows = runs(spark, d)
    numbers = sorted(r[0] for r in rows.select("run").distinct().collect())
    for i, run in enumerate(numbers):
        part = rows.filter(F.col("run") == run).select(
            F.concat(F.lit("q"), F.col("query_id")).alias("QueryID"), F.lit("a \"quoted\" query,\nof two lines").alias("Query"),
            F.col("category").alias("Category"), F.col("hi").alias("RerankerScoreMaxTop5"), F.col("lo").alias("RerankerScoreMinTop5"),
            F.col("precision").alias("PrecisionAt5"), F.col("recall").alias("RecallAt5"), F.lit(2).alias("RetrievalKeywordCountTop5"),
            F.lit(3).alias("RetrievalSemanticCountTop5"), F.col("FA").alias("RubricFactualAccuracy"), F.col("CA").alias("RubricCitationAccuracy"),
            F.col("HD").alias("RubricHistoriographicalDepth"), F.col("EC").alias("RubricEpistemicCalibration"),
        )
        files.write_csv(part, f"{base}/merged_run_{i}.csv")
    found, errors = files.read_runs(spark, [f"{base}/merged_run_{i}.csv" for i in range(len(numbers) + 1)])
    note = "missing" if len(errors) == 1 and f"merged_run_{len(numbers)}" in errors[0] else "unexpected"
    return found.select(
        "QueryID", F.col("run").cast("long").alias("run"), r6("FA").alias("FA"), r6("Rerank").alias("Rerank"), r6("RubricTotal").alias("RubricTotal"),
        F.lit(note).alias("errors"),
    )


@query("s6_csv_sink", "SELECT 'Text #: ' || doc_id AS text_id, text AS full_text, '[\"' || lang || '\",\"' || source || '\"]' AS keywords FROM documents")
def s6(spark, d):
    path = scratch_path(spark, "csv")
    files.write_csv(records(spark, d).select("text_id", "full_text", "keywords"), path)
    return spark.read.schema("text_id string, full_text string, keywords string").csv(path, header=True, multiLine=True, escape='"')


@query("s7_corpus_json_sink", SQL_RECORDS)
def s7(spark, d):
    path = scratch_path(spark, "corpus")
    files.write_corpus_json(records(spark, d).withColumn("embedding", F.array(F.lit(1.0))), path)
    return _short(files.read_corpus_json(spark, path, lines=True))


@query("s8_whole_text_scan")
def s8(spark, d):
    """Texts written as files by ``doc_id``, about 16 MB each; the manifest numbers the files against their sort order."""
    path = scratch_path(spark, "texts")
    docs = documents(spark, d)
    total = docs.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    parts = max(4, -(-total // FILE_BYTES))
    docs.repartition(parts, "doc_id").select("text").write.option("lineSep", "\u0001").text(path)
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name")
    )
    manifest = names.select(
        "file_name", (-F.regexp_extract("file_name", r"part-(\d+)", 1).cast("long")).alias("position"),
        F.concat(F.lit("label "), F.regexp_extract("file_name", r"part-(\d+)", 1)).alias("label"),
    )
    read = files.read_texts(spark, f"{path}/*.txt", manifest)
    return read.select("position", "label", F.length("full_text").cast("long").alias("n_chars"))


@query("s8_text_ranges", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(coalesce(text, '')) AS text_md5, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents""")
def s8_ranges(spark, d):
    """Texts behind their identifiers in large files, read in byte ranges that no file size widens."""
    path, end = scratch_path(spark, "ranges"), "\u0001"
    rows = table(spark, d, "documents").select(F.concat(F.col("doc_id"), F.lit("\t"), F.coalesce("text", F.lit(""))).alias("value"))
    rows.write.option("lineSep", end).text(path)
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name")
    )
    manifest = names.select("file_name", F.regexp_extract("file_name", r"part-(\d+)", 1).cast("long").alias("position"), F.lit("").alias("label"))
    ranges = splitscan.read_text_ranges(spark, f"{path}/*.txt", manifest, separator=end)
    read = ranges.select(F.explode(F.split("text", end)).alias("value"))
    body = F.substring("value", F.locate("\t", F.col("value")) + 1, F.length("value"))
    return read.select(
        F.substring_index("value", "\t", 1).alias("doc_id"), F.md5(body.cast("binary")).alias("text_md5"),
        F.octet_length(body).cast("long").alias("n_bytes"),
    )


@query("s9_sectioned_scan", f"""
SELECT 'Text #: ' || doc_id AS text_id, source, text AS full_text, 'in ' || lang AS summary, lang || '|' || source AS keywords FROM documents""")
def s9(spark, d):
    body = F.concat(
        F.lit("text_id: Text #: "), F.col("doc_id"), F.lit("\n\nsource: Source:  "), F.col("source"), F.lit('\n\nfull_text: "'),
        F.replace("text", F.lit("\n"), F.lit("\\n")), F.lit('"\n\nsummary: Summary: in '), F.col("lang"), F.lit("\n\nkeywords: Keywords:  "), F.col("lang"), F.lit(", "), F.col("source"), F.lit("\n"),
    )
    rows = files.parse_sections(documents(spark, d).select(body.alias("value")), "value")
    return rows.withColumn("keywords", F.array_join("keywords", "|"))


@query("s10_append_log", "SELECT event_id, event_type, value, true AS dated FROM events")
def s10(spark, d):
    path = scratch_path(spark, "log")
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    results.append_log(rows.filter("event_type = 'click'"), path)
    results.append_log(rows.filter("event_type <> 'click'"), path)
    log = results.read_log(spark, path, "event_id long, event_type string, value double")
    return log.select("event_id", "event_type", "value", (F.to_date("logged_at") == F.col("log_date")).alias("dated"))


@query("s11_keyword_log", f"""WITH {sql_ranked()}
SELECT b.text AS user_query, 'Text #: ' || chunk_id AS text_id, 'No key quote available.' AS key_quote, round(score + 1e-9, 6) AS weighted_score,
       CASE WHEN query_id % 2 = 1 THEN '[' || (query_id % 7) || ']' ELSE '[]' END AS year_keywords, CASE WHEN query_id % 3 = 0 THEN '["Source: src' || (query_id % 20) || '"]' ELSE '[]' END AS text_keywords
FROM ranked JOIN benchmark b ON b.item_id = query_id""")
def s11(spark, d):
    found = hits(spark, d).withColumn("quote", F.lit(None).cast("string")).withColumn(
        "keyword_counts", F.create_map(F.lit("k"), F.lit(1))
    )
    rows = results.keyword_log_rows(found, plans(spark, d))
    return rows.select("user_query", "text_id", "key_quote", r6("weighted_score").alias("weighted_score"), "year_keywords", "text_keywords")


@query("s11_vector_log", f"""WITH {SQL_CENTROIDS},
sims AS (SELECT query_id, vec_id, list_cosine_similarity(q, v) AS s FROM centroids, vecs)
SELECT 'label ' || query_id AS user_query, '' AS hyde_query, 'Text #: ' || vec_id AS text_id, round(s + 1e-9, 6) AS similarity, '' AS top_segment FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM sims) WHERE rank <= 5""")
def s11_vector(spark, d):
    asked = centroids(spark, d)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    named = asked.select("query_id", F.concat(F.lit("label "), F.col("query_id")).alias("query"), F.lit(None).cast("string").alias("initial_answer"))
    return results.vector_log_rows(vector.cosine_top(rows, asked, 5), named).withColumn("similarity", r6("similarity"))


@query("s11_rerank_log", f"""WITH {SQL_RERANKED}
SELECT 'question ' || query_id AS user_query, rank, search_type, text_id, full_text AS key_quote, round(relevance + 1e-9, 6) AS relevance FROM top""")
def s11_rerank(spark, d):
    asked = table(spark, d, "events").select(F.col("user_id").alias("query_id")).distinct().withColumn(
        "query", F.concat(F.lit("question "), F.col("query_id"))
    )
    return results.rerank_log_rows(reranked(spark, d), asked).withColumn("relevance", r6("relevance"))


@query("s11_answer_log", f"""WITH {SQL_ASSISTANT}
SELECT conv_id || ':' || turn AS user_query, CASE WHEN plain THEN 'No response available' ELSE text END AS final_answer, CASE WHEN plain THEN '' ELSE 'a, b' END AS "references",
  CASE WHEN plain THEN '' ELSE 'fact' END AS query_intent, CASE WHEN plain THEN '' ELSE 's' END AS synthesis, CASE WHEN plain OR n = 3 THEN '' ELSE 'none' END AS suggestions FROM a""")
def s11_answers(spark, d):
    rows = answer_documents(spark, d).select(F.concat_ws(":", "conv_id", "turn").alias("user_query"), F.lit("").alias("initial_answer"), "answer")
    return results.answer_log_rows(rows, "answer").select(
        "user_query", "final_answer", "references", "query_intent", "synthesis", "suggestions"
    )


RESULT = "query_id long, run long, category string, FA double, rubric_total double, notes string"


def stored_results(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "results")
    rows = runs(spark, d).select("category", "run", "query_id", "FA", F.col("rubric").alias("rubric_total"), F.lit("").alias("notes"))
    results.append_results(rows.filter("run <= 15"), path, RESULT)
    results.append_results(rows.filter("run > 15"), path, RESULT)
    return spark.read.schema(RESULT).parquet(path)


@query("s12_fixed_result_layout", f"""WITH {SQL_RUNS}
SELECT query_id, run, category, round(FA + 1e-9, 6) AS FA, round(rubric + 1e-9, 6) AS rubric_total, '' AS notes FROM tot""")
def s12(spark, d):
    return stored_results(spark, d).withColumn("FA", r6("FA")).withColumn("rubric_total", r6("rubric_total"))


SQL_UPDATED = f"""{SQL_RUNS},
st AS (SELECT query_id || ':' || run AS id, FA, '' AS notes FROM tot),
up AS (SELECT doc_id || ':1' AS id, CASE WHEN quality = 1 THEN 0.75 END AS FA, 'reviewed' AS notes FROM labels)"""


def updated(spark: SparkSession, d: str):
    key = F.concat_ws(":", "query_id", "run")
    stored = runs(spark, d).select(key.alias("id"), "FA", F.lit("").alias("notes"))
    updates = table(spark, d, "labels").select(
        F.concat(F.col("doc_id"), F.lit(":1")).alias("id"), F.when(F.col("quality") == 1, 0.75).alias("FA"), F.lit("reviewed").alias("notes")
    )
    return results.update_results(stored, updates, "id")


@query("s13_keyed_update", f"""WITH {SQL_UPDATED}
SELECT st.id, round(coalesce(up.FA, st.FA) + 1e-9, 6) AS FA, coalesce(up.notes, st.notes) AS notes FROM st LEFT JOIN up USING (id)""")
def s13(spark, d):
    return updated(spark, d)[0].withColumn("FA", r6("FA"))


@query("s13_unmatched_updates", f"WITH {SQL_UPDATED} SELECT id FROM up WHERE id NOT IN (SELECT id FROM st)")
def s13_unmatched(spark, d):
    return updated(spark, d)[1].select("id")


@query("s14_passage_map", f"""
SELECT doc_id AS passage_id, 'Text #: ' || (n_chars % 50) AS doc_id, n_chars AS n_tokens FROM documents""")
def s14(spark, d):
    rows = documents(spark, d)
    maps = rows.select(
        F.to_json(F.create_map(F.col("doc_id").cast("string"), F.concat(F.lit("Text #: "), F.col("n_chars") % 50))).alias("value")
    )
    placed = files.passage_map(maps, "value")
    # Lengths by position: one array per document file here, so the position is its number.
    lengths = rows.select("doc_id", F.to_json(F.array("n_chars")).alias("value"))
    per = lengths.select(F.col("doc_id").alias("passage_id"), F.explode(F.from_json("value", "array<bigint>")).alias("n_tokens"))
    return placed.join(per, "passage_id")
