"""Registered queries: model outputs, curation, enrichment, sources and sinks.

Model outputs are built as JSON from events and conversations and then read back with the
library, while the SQL computes the expected values from the base columns.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import text as tx
from textloom.operators import curate, enrich, irmetrics, outputs, overlap
from textloom.plans.metric_queries import (
    SQL_EVENT, SQL_PAIRS, answer_pairs, event_hits, sql_f1, sql_grams, sql_overlap,
)
from textloom.plans.prep_queries import SQL_TERMS, documents, terms
from textloom.plans.registry import query, r6, sql_runs, table
from textloom.session import scratch_path

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


# ---- classification ----------------------------------------------------------------------------

ASSESSMENT = """CASE event_type WHEN 'view' THEN 'This is a type ' || chr(CAST(65 + k % 6 AS INT)) || ': lookup.'
 WHEN 'click' THEN 'Inferential Retrieval over passages. This trains the model.' WHEN 'purchase' THEN 'A multi-passage synthesis, with absence recognition'
 WHEN 'signup' THEN 'historiographical question' ELSE 'no label' END"""
SQL_TASK = "CASE event_type WHEN 'view' THEN CASE WHEN k % 6 < 5 THEN chr(CAST(65 + k % 6 AS INT)) END WHEN 'click' THEN 'B' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'E' END"
SQL_EV = f"ev AS (SELECT *, {K} AS k FROM events)"


@query("j1_task_type", f"WITH {SQL_EV} SELECT event_id, {SQL_TASK} AS task_type FROM ev")
def j1(spark, d):
    return events(spark, d).select("event_id", outputs.task_type(F.expr(ASSESSMENT)).alias("task_type"))


SYNTHESIS = "CASE WHEN k % 3 = 0 THEN 'Type ' || (k % 9) || ' answer' WHEN k % 3 = 1 THEN 'a TYPE' || (k % 7) ELSE 'untyped' END"


@query("j2_synthesis_type", f"""WITH {SQL_EV}
SELECT event_id, CASE WHEN k % 3 = 0 AND k % 9 BETWEEN 1 AND 5 THEN 'T' || (k % 9) WHEN k % 3 = 1 AND k % 7 BETWEEN 1 AND 5 THEN 'T' || (k % 7) END AS synthesis_type,
       CASE WHEN k % 3 = 0 THEN k % 9 ELSE 3 END AS synthesis_number FROM ev""")
def j2(spark, d):
    s = F.expr(SYNTHESIS)
    return events(spark, d).select(
        "event_id", outputs.synthesis_type(s).alias("synthesis_type"), outputs.synthesis_number(s).alias("synthesis_number")
    )


@query("j3_unknown_fields", f"""WITH {SQL_EV}
SELECT event_id, CASE WHEN event_type = 'click' THEN 'k,reasoning' ELSE 'k' END AS unknown FROM ev""")
def j3(spark, d):
    plan = F.to_json(F.struct(
        F.lit("x").alias("initial_answer"), F.col("k"), F.when(F.col("event_type") == "click", "y").alias("reasoning"),
        F.array("k").alias("year_keywords"),
    ))
    return events(spark, d).select("event_id", F.array_join(outputs.unknown_fields(plan), ",").alias("unknown"))


def answer_documents(spark: SparkSession, d: str) -> DataFrame:
    """An answer document per assistant turn; some lack a section or give a plain FinalAnswer."""
    n, text = F.length("text") % 4, F.col("text")

    def match(i: int, level):
        return F.struct(
            F.concat(F.lit("Text #: "), F.col("turn") * 7 + i).alias("Text ID"), F.lit("Source: src1").alias("Source"),
            text.alias("Key Quote"), level.alias("Relevance Assessment"),
        )

    levels = [
        F.when(n == 0, "High — direct, strong").otherwise("Moderate, partial"),
        F.when(n == 1, "Low: off topic").otherwise("medium"),
        F.when(n < 2, "Low").otherwise("unrated"),
    ]
    assessed = F.concat(F.lit("Type "), F.col("turn") % 5 + 1)
    with_text = F.to_json(F.struct(
        F.struct(F.when(n != 2, assessed).alias("synthesis_assessment"), F.lit("fact").alias("Query Intent")).alias("User Query Analysis"),
        F.struct(F.lit("fine").alias("Answer Evaluation")).alias("Initial Answer Review"),
        F.create_map(F.lit("Match 1"), match(1, levels[0]), F.lit("Match 2"), match(2, levels[1]), F.lit("Match 3"), match(3, levels[2])).alias("Match Analysis"),
        F.struct(F.when(n == 2, assessed).alias("synthesis_assessment"), F.lit("s").alias("Synthesis")).alias("Meta Analysis"),
        F.struct(text.alias("Text"), F.array(F.lit("a"), F.lit("b")).alias("References")).alias("FinalAnswer"),
        F.when(n != 3, F.struct(F.lit("none").alias("Suggestions for Improvement"))).alias("Model Feedback"),
    ))
    plain = F.to_json(F.struct(text.alias("FinalAnswer"), F.struct(assessed.alias("synthesis_assessment")).alias("Meta Analysis")))
    rows = table(spark, d, "conversations").filter("role = 'assistant'")
    return rows.select("conv_id", "turn", "text", F.when(F.col("turn") % 3 == 0, plain).otherwise(with_text).alias("answer"))


SQL_ASSISTANT = "a AS (SELECT conv_id, turn, text, length(text) % 4 AS n, turn % 3 = 0 AS plain FROM conversations WHERE role = 'assistant')"


@query("j4_required_sections", f"""WITH {SQL_ASSISTANT}
SELECT conv_id, turn, NOT plain AND n <> 3 AS complete, CASE WHEN plain THEN 2 WHEN n = 3 THEN 5 ELSE 6 END::BIGINT AS n_sections FROM a""")
def j4(spark, d):
    flags = outputs.section_flags(F.col("answer"))
    return answer_documents(spark, d).select(
        "conv_id", "turn", outputs.is_complete(F.col("answer")).alias("complete"),
        F.size(F.filter(F.map_values(flags), lambda f: f)).cast("long").alias("n_sections"),
    )


@query("j5_answer_text", "SELECT conv_id, turn, text AS answer_text FROM conversations WHERE role = 'assistant'")
def j5(spark, d):
    return answer_documents(spark, d).select("conv_id", "turn", outputs.answer_text(F.col("answer")).alias("answer_text"))


@query("j6_section_fallback", "SELECT conv_id, turn, 'Type ' || (turn % 5 + 1) AS assessment FROM conversations WHERE role = 'assistant'")
def j6(spark, d):
    return answer_documents(spark, d).select("conv_id", "turn", outputs.synthesis_assessment(F.col("answer")).alias("assessment"))


@query("j7_plan_parsing", f"""WITH {SQL_EV}
SELECT event_id, CASE WHEN event_type = 'error' THEN 'question ' || event_id ELSE 'draft ' || k END AS initial_answer,
       CASE WHEN event_type = 'error' THEN '' ELSE 'union=' || k || '.0' END AS keywords, CASE WHEN event_type IN ('error', 'view') THEN '' ELSE CAST(1800 + k AS VARCHAR) END AS years,
       event_type = 'error' AS failed FROM ev""")
def j7(spark, d):
    k = F.col("k")
    body = F.to_json(F.struct(
        F.concat(F.lit("draft "), k).alias("initial_answer"), F.create_map(F.lit("union"), k).alias("weighted_keywords"),
        F.when(F.col("event_type") != "view", F.array((k + 1800).cast("int"))).alias("year_keywords"),
    ))
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("```json\n{\"initial_answer\": "), k)).when(
        F.col("event_type") == "click", F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    ).otherwise(body)
    rows = events(spark, d).select("event_id", raw.alias("raw"), F.concat(F.lit("question "), F.col("event_id")).alias("query"))
    p = outputs.parse_plans(rows, "raw", "query")
    listed = F.transform(F.map_entries("weighted_keywords"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return p.select(
        "event_id", "initial_answer", F.array_join(listed, ",").alias("keywords"),
        F.array_join(F.col("year_keywords").cast("array<string>"), ",").alias("years"), F.col("error").isNotNull().alias("failed"),
    )


@query("j8_confidence", f"""WITH {SQL_EVENT},
prof AS (SELECT query_id, max(score) >= 0.70 AND round(max(score) - min(score), 4) <= 0.08 AS warning FROM h WHERE rank <= 5 GROUP BY query_id),
{SQL_PAIRS},{sql_grams(sql_overlap, (1,))},
rg AS (SELECT CAST(split_part(p.pair_id, ':', 1) AS BIGINT) AS query_id, max(coalesce(r1, 0)) AS rouge1 FROM pairs p LEFT JOIN (SELECT pair_id, {sql_f1(1)} AS r1 FROM ov GROUP BY pair_id) USING (pair_id) GROUP BY 1),
bad AS (SELECT conv_id AS query_id, count(*) FILTER (length(text) < 40) AS n_bad, count(*) % 5 + 1 AS synthesis FROM conversations GROUP BY conv_id)
SELECT query_id, CASE WHEN n_bad > 0 THEN 'low' WHEN coalesce(warning, false) THEN 'low' WHEN synthesis IN (1, 2) AND coalesce(rouge1, 0) < 0.25 THEN 'low' WHEN synthesis = 3 THEN 'high'
       WHEN coalesce(rouge1, 0) >= CASE WHEN synthesis IN (1, 2) THEN 0.45 ELSE 0.30 END THEN 'high' ELSE 'medium' END AS confidence
FROM bad LEFT JOIN prof USING (query_id) LEFT JOIN rg USING (query_id)""")
def j8(spark, d):
    profile = irmetrics.score_profile(event_hits(spark, d)).select("query_id", "calibration_warning")
    scored = overlap.rouge(answer_pairs(spark, d), (1,)).groupBy(
        F.element_at(F.split("pair_id", ":"), 1).cast("long").alias("query_id")
    ).agg(F.max("rouge1").alias("rouge1"))
    bad = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.count_if(F.length("text") < 40).alias("n_bad"), (F.count("*") % 5 + 1).alias("synthesis")
    )
    joined = bad.join(profile, "query_id", "left").join(scored, "query_id", "left")
    return joined.select(
        "query_id",
        outputs.confidence(F.col("n_bad"), F.col("calibration_warning"), F.col("rouge1"), F.col("synthesis")).alias("confidence"),
    )


@query("j9_correctness_flags", f"""WITH {SQL_EV}, t AS (SELECT event_id, event_type, {SQL_TASK} AS got, chr(CAST(65 + k % 5 AS INT)) AS want FROM ev)
SELECT event_id, got AS task_type, CASE WHEN got IS NOT NULL THEN got = want END AS task_correct, event_type = 'click' AS training_bleed FROM t""")
def j9(spark, d):
    want = F.expr("chr(CAST(65 + k % 5 AS INT))")
    return events(spark, d).select("event_id", *outputs.task_flags(F.expr(ASSESSMENT), want))


SQL_LEVELS = """
l AS (SELECT conv_id, turn, unnest(['Match 1', 'Match 2', 'Match 3']) AS match, unnest([CASE WHEN n = 0 THEN 'High — direct, strong' ELSE 'Moderate, partial' END,
      CASE WHEN n = 1 THEN 'Low: off topic' ELSE 'medium' END, CASE WHEN n < 2 THEN 'Low' ELSE 'unrated' END]) AS assessment FROM a WHERE NOT plain)"""


@query("j10_relevance_map", f"WITH {SQL_ASSISTANT},{SQL_LEVELS} SELECT conv_id, turn, match, assessment FROM l")
def j10(spark, d):
    return relevance_rows(spark, d)


def relevance_rows(spark: SparkSession, d: str) -> DataFrame:
    m = outputs.relevance_map(outputs.match_map(F.col("answer")))
    return answer_documents(spark, d).select("conv_id", "turn", F.explode(m).alias("match", "assessment"))


@query("j14_relevance_level", f"""WITH {SQL_ASSISTANT},{SQL_LEVELS}
SELECT conv_id, turn, match, CASE WHEN assessment LIKE 'High%' THEN 'high' WHEN assessment IN ('medium', 'Moderate, partial') THEN 'medium' WHEN assessment LIKE 'Low%' THEN 'low' ELSE 'other' END AS level,
       CASE WHEN assessment LIKE 'High%' THEN 'High' WHEN assessment LIKE 'Mod%' THEN 'Moderate' ELSE assessment END AS label FROM l""")
def j14(spark, d):
    return relevance_rows(spark, d).select(
        "conv_id", "turn", "match", outputs.relevance_level(F.col("assessment")).alias("level"),
        outputs.relevance_label(F.col("assessment")).alias("label"),
    )


@query("j11_judge_scores", f"""WITH {SQL_EV}
SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE k END::DOUBLE AS quote_usage_score, 0::DOUBLE AS citation_accuracy_score,
       CASE WHEN event_type = 'click' THEN 0 ELSE value END AS total_score, CASE WHEN event_type = 'click' THEN '[]' ELSE '["s' || k || '"]' END AS strengths, '[]' AS weaknesses FROM ev""")
def j11(spark, d):
    e = F.col("event_type")
    judged = F.to_json(F.struct(
        F.struct(F.when(e != "view", F.struct(F.col("k").alias("score"))).alias("quote_usage")).alias("evaluation_scores"),
        F.when(e != "click", F.struct(
            F.col("value").alias("total_score"), F.array(F.concat(F.lit("s"), F.col("k"))).alias("strengths")
        )).alias("overall_assessment"),
    ))
    rows = events(spark, d).select("event_id", judged.alias("judged"))
    return outputs.judge_scores(rows, "judged").select(
        "event_id", "quote_usage_score", "citation_accuracy_score", "total_score", "strengths", "weaknesses"
    )


@query("j12_relevant_evidence", """
WITH v AS (SELECT conv_id, turn, text, CASE length(text) % 3 WHEN 0 THEN 'Relevance Explanation: clearly' || chr(10) || 'RELEVANT here' WHEN 1 THEN 'This section is relevant' ELSE 'off topic' END AS verdict, length(text) % 3 < 2 AS yes FROM conversations)
SELECT conv_id, count(*) AS n_relevant, string_agg(text || chr(10) || 'Key Terms' || chr(10) || verdict, chr(10) || chr(10) ORDER BY turn) AS evidence FROM v WHERE yes GROUP BY conv_id""")
def j12(spark, d):
    n = F.length("text") % 3
    verdict = F.when(n == 0, "Relevance Explanation: clearly\nRELEVANT here").when(n == 1, "This section is relevant").otherwise("off topic")
    rows = table(spark, d, "conversations").withColumn("verdict", verdict)
    return outputs.relevant_evidence(rows, "conv_id", "turn", "text", "verdict")


@query("j13_user_rating", f"""WITH {SQL_EV}
SELECT user_id, round(avg((value + k + length(event_type) + event_id % 5) / 4) + 1e-9, 6) AS rating FROM ev GROUP BY user_id""")
def j13(spark, d):
    rows = events(spark, d).select(
        "user_id", outputs.rating_average(F.col("value"), F.col("k"), F.length("event_type"), F.col("event_id") % 5).alias("rating")
    )
    return rows.groupBy("user_id").agg(r6(F.avg("rating")).alias("rating"))


@query("j15_query_complexity", """
WITH q AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Compare: ' WHEN 1 THEN 'How did the text change? ' WHEN 2 THEN 'Across time, ' ELSE 'xx ' END || text AS query, item_id % 5 + 1 AS synthesis FROM benchmark)
SELECT item_id, CASE WHEN regexp_matches(query, '(?i)(compare|contrast|how did .+ change|evolution of|shift|differ|difference|between|throughout|across|over time|consistent|inconsistent|develop|arc|trajectory)') THEN 'high' ELSE 'moderate' END AS complexity,
       regexp_matches(query, '(?i)(compare|contrast|how did .+ change|evolution of|shift|differ|difference|between|throughout|across|over time|consistent|inconsistent|develop|arc|trajectory)') AND synthesis IN (1, 2) AS mismatch FROM q""")
def j15(spark, d):
    n = F.col("item_id") % 4
    head = F.when(n == 0, "Compare: ").when(n == 1, "How did the text change? ").when(n == 2, "Across time, ").otherwise("xx ")
    text = F.concat(head, "text")
    return table(spark, d, "benchmark").select(
        "item_id", outputs.complexity(text).alias("complexity"), outputs.complexity_mismatch(text, F.col("item_id") % 5 + 1).alias("mismatch")
    )


# ---- curation ----------------------------------------------------------------------------------

SQL_EXAMPLES = f"""
ex AS (SELECT item_id AS example_id, item_id AS chunk_id, unnest(list_distinct({sql_runs('text')})) AS keyword FROM benchmark),
kw AS (SELECT example_id, chunk_id, keyword, length(keyword) * 2 AS weight FROM ex
       UNION ALL SELECT item_id, item_id, 'zzabsent', 16 FROM benchmark WHERE item_id % 3 = 0),
au AS (SELECT k.*, coalesce(raw_freq, 0) AS raw_freq, CASE WHEN raw_freq IS NULL THEN 'ABSENT' WHEN raw_freq <= 14 AND weight >= 15 THEN 'STRONG' WHEN raw_freq <= 50 AND weight >= 8 THEN 'OK'
       WHEN raw_freq > 50 AND weight >= 15 THEN 'WEAK' ELSE 'OK' END AS quality, contains(lower(d.text), k.keyword) AS in_chunk
       FROM kw k LEFT JOIN terms t ON t.term = k.keyword LEFT JOIN documents d ON d.doc_id = k.chunk_id)"""


def training_examples(spark: SparkSession, d: str) -> DataFrame:
    item = F.col("item_id")
    words = F.array_distinct(tx.word_runs(F.col("text")))
    words = F.when(item % 3 == 0, F.array_append(words, F.lit("zzabsent"))).otherwise(words)
    return table(spark, d, "benchmark").select(
        item.alias("example_id"), item.alias("chunk_id"),
        F.map_from_arrays(words, F.transform(words, lambda w: (F.length(w) * 2).cast("double"))).alias("weighted_keywords"),
    )


@query("t11_keyword_audit", f"WITH {SQL_TERMS},{SQL_EXAMPLES} SELECT example_id, keyword, raw_freq, quality, in_chunk FROM au")
def t11(spark, d):
    return audit(spark, d).select("example_id", "keyword", "raw_freq", "quality", "in_chunk")


def audit(spark: SparkSession, d: str) -> DataFrame:
    chunks = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("full_text"))
    return curate.keyword_audit(training_examples(spark, d), terms(spark, d), chunks)


@query("t11_audit_verdict", f"""WITH {SQL_TERMS},{SQL_EXAMPLES}
SELECT example_id, count(*) AS n_keywords, bool_and(quality NOT IN ('ABSENT', 'WEAK')) AS passed, count(*) FILTER (NOT in_chunk) AS n_not_in_chunk FROM au GROUP BY example_id""")
def t11_verdict(spark, d):
    return curate.audit_verdict(audit(spark, d))


@query("t12_dataset_balance", """
SELECT count(*) FILTER (length(text) >= 60) AS n_positive, count(*) FILTER (length(text) < 60) AS n_refusal,
       CAST(floor(count(*) FILTER (length(text) >= 60) / nullif(count(*) FILTER (length(text) < 60), 0)) AS BIGINT) AS positives_per_refusal FROM conversations""")
def t12(spark, d):
    rows = table(spark, d, "conversations").select(
        F.when(F.length("text") >= 60, F.create_map(F.col("role"), F.col("turn"))).alias("weighted_keywords")
    )
    return curate.balance(rows, "weighted_keywords")


@query("t12_section_counts", "SELECT coalesce(role, '?') AS section, count(*) AS n FROM conversations GROUP BY 1")
def t12_sections(spark, d):
    return curate.by_section(table(spark, d, "conversations"), "role")


# Every third answer is given as JSON, so that both outcomes occur.
@query("t13_conversation_validation", """
WITH c AS (SELECT conv_id, count(*) AS n_turns, list(role ORDER BY turn) = ['system', 'user', 'assistant'] AS roles_ok,
  arg_min(turn % 3 = 0, turn) FILTER (role = 'assistant') AS json_ok FROM conversations GROUP BY conv_id)
SELECT *, roles_ok AND coalesce(json_ok, true) AS valid FROM c""")
def t13(spark, d):
    turns = table(spark, d, "conversations").withColumn(
        "text", F.when(F.col("turn") % 3 == 0, F.to_json(F.struct("text"))).otherwise(F.concat(F.lit("= "), "text"))
    )
    return curate.validate_conversations(turns)


@query("t14_contamination_exclusion", """
SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def t14(spark, d):
    used = table(spark, d, "labels").filter("quality = 1")
    log = curate.usage_log(used, "chunk", F.col("doc_id"), F.lit("s1"))
    return curate.exclude_used(documents(spark, d), "doc_id", log, "chunk").select("doc_id")


@query("t15_dataset_merge", """
SELECT conv_id AS example_id, text FROM conversations
UNION ALL SELECT d.doc_id, d.text FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1""")
def t15(spark, d):
    return merged_examples(spark, d)[0]


def merged_examples(spark: SparkSession, d: str):
    old = table(spark, d, "conversations").select(F.col("conv_id").alias("example_id"), "text")
    new = documents(spark, d).join(table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("example_id"), "text", (F.col("quality") == 1).alias("approved")
    )
    return curate.merge_examples(old, new, "approved")


@query("t15_merge_counts", """
SELECT (SELECT count(*) FROM conversations) AS n_existing, (SELECT count(*) FROM labels WHERE quality = 1) AS n_new,
       (SELECT count(*) FROM conversations) + (SELECT count(*) FROM labels WHERE quality = 1) AS n_merged""")
def t15_counts(spark, d):
    return merged_examples(spark, d)[1]


@query("t16_training_records", """
SELECT a.conv_id, a.turn, json_array(json_object('role', 'system', 'content', 'Answer from the matches.'),
   json_object('role', 'user', 'content', 'User Query: ' || u.text || chr(10) || chr(10) || 'Initial Answer: draft' || chr(10) || chr(10)
     || 'Match 1: Text ID - Text #: 1, Source - own, Summary - s, Full Text (select the most relevant passage to quote directly) - ' || left(a.text, 900) || ', Relevance Score - 0.82'),
   json_object('role', 'assistant', 'content', a.text))::VARCHAR AS messages
FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant'""")
def t16(spark, d):
    turns = table(spark, d, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
    rows = turns.filter("role = 'assistant'").join(asked, ["conv_id", "turn"])
    match = F.struct(F.lit("Text #: 1").alias("text_id"), F.lit("own").alias("source"), F.lit("s").alias("summary"), F.col("text").alias("full_text"))
    user = curate.example_input(F.col("query"), F.lit("draft"), F.array(match))
    return rows.select("conv_id", "turn", F.to_json(curate.training_record(F.lit("Answer from the matches."), user, F.col("text"))).alias("messages"))


@query("t17_phrase_audit", """
SELECT doc_id AS example_id, CAST(contains(lower(text), 'token =') AS BIGINT) + CAST(contains(lower(text), '###') AS BIGINT) AS n_forbidden,
       CAST(contains(lower(text), 'the') AS BIGINT) + CAST(contains(lower(text), 'und') AS BIGINT) AS n_required,
       NOT contains(lower(text), 'token =') AND NOT contains(lower(text), '###') AND (contains(lower(text), 'the') OR contains(lower(text), 'und')) AS passed FROM documents""")
def t17(spark, d):
    phrases = spark.createDataFrame(
        [("forbidden", "TOKEN ="), ("forbidden", "###"), ("required", "The"), ("required", "und")], "kind string, phrase string"
    )
    answers = documents(spark, d).select(F.col("doc_id").alias("example_id"), F.col("text").alias("answer"))
    return curate.phrase_audit(answers, phrases)


@query("t18_scope_audit", f"WITH {SQL_ASSISTANT} SELECT conv_id || ':' || turn AS example_id, NOT plain AND n = 1 AS scope_ok FROM a")
def t18(spark, d):
    rows = answer_documents(spark, d).select(
        F.concat_ws(":", "conv_id", "turn").alias("example_id"),
        outputs.relevance_map(outputs.match_map(F.col("answer"))).alias("relevance"),
    )
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return curate.scope_audit(rows.withColumn("relevance", F.coalesce("relevance", empty)), "relevance")


@query("t19_context_set", """
WITH t AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'),
w AS (SELECT conv_id, turn, unnest([0, 1, 2]) AS o, unnest([0, 1, -1]) AS d FROM t)
SELECT w.conv_id || ':' || w.turn AS example_id, row_number() OVER (PARTITION BY w.conv_id, w.turn ORDER BY o) AS place, c.conv_id || ':' || c.turn AS chunk_id
FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + w.d""")
def t19(spark, d):
    key = F.concat_ws(":", "conv_id", "turn")
    turns = table(spark, d, "conversations")
    corpus = turns.select(key.alias("chunk_id"), F.col("conv_id").alias("source_file"), F.col("turn").alias("position"))
    targets = turns.filter("role = 'assistant'").select(key.alias("example_id"), key.alias("chunk_id"))
    return curate.context_set(targets, corpus)


# ---- enrichment ----------------------------------------------------------------------------------


def hashed_metadata(texts: list[str]) -> pd.DataFrame:
    """Deterministic stand-in for a model: a short digest and the number of words."""
    return pd.DataFrame({
        "digest": [hashlib.sha1(t.encode()).hexdigest()[:12] for t in texts], "n_words": [len(t.split(" ")) for t in texts],
    })


@query("x1_batch_enrichment", "SELECT doc_id, left(sha1(text), 12) AS digest, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words FROM documents")
def x1(spark, d):
    rows = documents(spark, d).select("doc_id", "text")
    return enrich.enrich_batches(rows, "text", hashed_metadata, "digest string, n_words long")


@query("x2_resumed_enrichment", "SELECT doc_id, left(sha1(text), 12) AS digest, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words FROM documents")
def x2(spark, d):
    path, schema = scratch_path(spark, "enriched"), "digest string, n_words long"
    rows = documents(spark, d).select("doc_id", "text")
    # A first run on an older state of the corpus: other texts for documents not in English.
    outdated = F.when(F.col("lang") == "en", F.col("text")).otherwise("outdated")
    older = documents(spark, d).select("doc_id", outdated.alias("text"))
    enrich.resume_enrichment(older, "doc_id", "text", path, hashed_metadata, schema)
    return enrich.resume_enrichment(rows, "doc_id", "text", path, hashed_metadata, schema).select("doc_id", "digest", "n_words")
