"""Registered queries: keyword, vector and late-interaction retrieval, fusion and reranking.

Benchmark items act as queries: their distinct words of four or more letters are the keywords,
the word length is the user weight, and the item number sets year and source constraints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import text as tx
from textloom.operators import fusion, keyword, vector
from textloom.plans.prep_queries import SQL_TERMS, documents, terms
from textloom.plans.registry import query, r6, sql_runs, table
from textloom.session import cut_lineage


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(
        F.col("doc_id").alias("chunk_id"), "source", F.col("text").alias("full_text"),
        F.concat(F.lit("Passage in "), F.col("lang")).alias("summary"), F.array("source").alias("keywords"),
    )


def plans(spark: SparkSession, d: str) -> DataFrame:
    item = F.col("item_id")
    words = F.array_distinct(tx.word_runs(F.col("text")))
    return table(spark, d, "benchmark").select(
        item.alias("query_id"), F.col("text").alias("query"), F.lit("").alias("initial_answer"),
        F.map_from_arrays(words, F.transform(words, lambda w: F.length(w).cast("double"))).alias("weighted_keywords"),
        F.when(item % 2 == 1, F.array((item % 7).cast("int"))).otherwise(F.array().cast("array<int>")).alias("year_keywords"),
        F.when(item % 3 == 0, F.array(F.concat(F.lit("Source: src"), item % 20))).otherwise(
            F.array().cast("array<string>")
        ).alias("text_keywords"),
    )


SQL_KEYWORDS = f"""{SQL_TERMS},
kw AS (SELECT DISTINCT item_id AS query_id, w AS keyword, CAST(length(w) AS DOUBLE) AS user_weight
       FROM (SELECT item_id, unnest({sql_runs('text')}) AS w FROM benchmark)),
rel AS (SELECT term, raw_freq / (SELECT sum(raw_freq) FROM terms) AS f FROM terms)"""


def sql_weights(absent: str = "(SELECT min(f) FROM rel)") -> str:
    return f"""{SQL_KEYWORDS},
raw AS (SELECT query_id, keyword, user_weight, 1 / coalesce(f, {absent}) AS w FROM kw LEFT JOIN rel ON term = keyword),
weights AS (SELECT query_id, keyword, user_weight, w / max(w) OVER (PARTITION BY query_id) * 10 AS weight FROM raw)"""


# Words of the searched text: body, summary and keywords.
SQL_COUNTS = f"""
found AS (SELECT doc_id, source, unnest({sql_runs("text || ' passage in ' || lang || ' ' || source")}) AS term FROM documents),
counts AS (SELECT doc_id, source, term, count(*) AS n FROM found GROUP BY ALL)"""


def sql_scores(absent: str = "(SELECT min(f) FROM rel)", value: str = "n * weight") -> str:
    return f"""{sql_weights(absent)},{SQL_COUNTS},
scores AS (SELECT query_id, doc_id, source, sum({value}) AS score FROM counts JOIN weights ON term = keyword GROUP BY ALL)"""


SQL_YEAR = "(query_id % 2 = 0 OR contains(source, CAST(query_id % 7 AS VARCHAR)))"
SQL_TEXT = "(query_id % 3 <> 0 OR contains(source, 'src' || (query_id % 20)))"


def sql_ranked(boost: str = "multiply", n: int = 5) -> str:
    if boost == "multiply":
        head, lifted = sql_scores(), f"score * CASE WHEN {SQL_YEAR} THEN 1.5 ELSE 1 END * CASE WHEN {SQL_TEXT} THEN 1.8 ELSE 1 END"
        gate = "true"
    elif boost == "add":
        head, lifted = sql_scores("1"), f"score + CASE WHEN {SQL_YEAR} THEN 5 ELSE 0 END + CASE WHEN {SQL_TEXT} THEN 8 ELSE 0 END"
        gate = "true"
    else:
        head, lifted = sql_scores("1", "n * n * weight"), "score"
        # The strict form looks for the label as it is written, 'source: srcN' here, so it never matches.
        gate = f"{SQL_YEAR} AND query_id % 3 <> 0"
    bucket = "0" if boost == "strict" else f"CASE WHEN {SQL_YEAR} AND {SQL_TEXT} THEN 0 WHEN {SQL_YEAR} THEN 1 ELSE 2 END"
    return f"""{head},
lifted AS (SELECT query_id, doc_id AS chunk_id, source, {bucket} AS bucket, {lifted} AS score FROM scores WHERE {gate}),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bucket, round(score, 9) DESC, chunk_id) AS rank FROM lifted) WHERE rank <= {n})"""


@query("r1_keyword_weights", f"WITH {sql_weights()} SELECT query_id, keyword, round(weight + 1e-9, 6) AS weight FROM weights")
def r1(spark, d):
    w = keyword.keyword_weights(plans(spark, d), terms(spark, d))
    return w.select("query_id", "keyword", r6("weight").alias("weight"))


@query("r2_keyword_scores", f"WITH {sql_scores()} SELECT query_id, doc_id AS chunk_id, round(score + 1e-9, 6) AS score FROM scores")
def r2(spark, d):
    w = keyword.keyword_weights(plans(spark, d), terms(spark, d))
    return keyword.keyword_scores(corpus(spark, d), w).select("query_id", "chunk_id", r6("score").alias("score"))


# Adjacent words of a benchmark item, as two-word keywords.
SQL_PHRASES = f"""
w AS (SELECT item_id, {sql_runs('text')} AS ws FROM benchmark),
phrases AS (SELECT DISTINCT item_id AS query_id, ws[i] || ' ' || ws[i + 1] AS phrase FROM (SELECT item_id, ws, unnest(range(1, len(ws))) AS i FROM w))"""


@query("r2_phrase_scores", f"""WITH {SQL_PHRASES},
docs AS (SELECT doc_id, ' ' || array_to_string(list_transform(regexp_extract_all(lower(text || ' passage in ' || lang || ' ' || source), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'),
            lambda r: CASE WHEN regexp_matches(r, '^[\\p{{L}}\\p{{N}}_]') THEN r WHEN r = ' ' THEN '  ' ELSE ' # ' END), '') || ' ' AS body FROM documents),
hits AS (SELECT query_id, doc_id, phrase, len(string_split(replace(body, ' ', '  '), ' ' || replace(phrase, ' ', '    ') || ' ')) - 1 AS n
         FROM phrases JOIN docs ON contains(replace(body, ' ', '  '), ' ' || replace(phrase, ' ', '    ') || ' '))
SELECT query_id, doc_id AS chunk_id, CAST(sum(n) * 10 AS DOUBLE) AS score FROM hits GROUP BY ALL""")
def r2_phrases(spark, d):
    runs = tx.word_runs(F.col("text"))
    pairs = F.transform(F.sequence(F.lit(1), F.size(runs) - 1), lambda i: F.array_join(F.slice(runs, i, F.lit(2)), " "))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(pairs)).alias("keyword"))
    weights = asked.select("query_id", "keyword", F.col("keyword").alias("key"), F.lit(1.0).alias("user_weight"), F.lit(10.0).alias("weight"))
    return keyword.keyword_scores(corpus(spark, d), weights).select("query_id", "chunk_id", "score")


@query("r3_soft_constraints", f"""WITH {sql_ranked()}
SELECT query_id, chunk_id, CAST(bucket AS BIGINT) AS bucket, round(score + 1e-9, 6) AS score FROM lifted""")
def r3(spark, d):
    p = plans(spark, d)
    scores = keyword.keyword_scores(corpus(spark, d), keyword.keyword_weights(p, terms(spark, d)), labelled=True)
    out = keyword.constrained(scores, p)
    return out.select("query_id", "chunk_id", F.col("bucket").cast("long").alias("bucket"), r6("score").alias("score"))


def hits(spark: SparkSession, d: str, n: int = 5, weights: DataFrame | None = None) -> DataFrame:
    p = plans(spark, d)
    w = keyword.keyword_weights(p, terms(spark, d)) if weights is None else weights
    scores = keyword.keyword_scores(corpus(spark, d), w, labelled=True, best=n)
    # A few rows per query, read several times by the metrics: stored once.
    return cut_lineage(keyword.ranked_hits(keyword.constrained(scores, p), n), "ranked-hits")


@query("r4_bucketed_top_n", f"WITH {sql_ranked()} SELECT query_id, rank, chunk_id, source, round(score + 1e-9, 6) AS score FROM ranked")
def r4(spark, d):
    return hits(spark, d).select("query_id", "rank", "chunk_id", "source", r6("score").alias("score"))


# Keyword positions from the lengths of all runs before a word.
SQL_SNIPPET = f"""
body AS (SELECT r.query_id, r.rank, r.chunk_id, r.source, r.score, d.text FROM ranked r JOIN documents d ON d.doc_id = r.chunk_id),
runs AS (SELECT query_id, chunk_id, unnest(range(len(rs))) AS i, unnest(rs) AS run FROM
         (SELECT query_id, chunk_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS rs FROM body)),
placed AS (SELECT query_id, chunk_id, run, coalesce(sum(length(run)) OVER (PARTITION BY query_id, chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM runs),
found_at AS (SELECT p.query_id, p.chunk_id, p.pos, w.weight, w.user_weight FROM placed p JOIN weights w ON w.query_id = p.query_id AND w.keyword = p.run)"""
SQL_CENTRE = f"""{SQL_SNIPPET},
starts AS (SELECT DISTINCT query_id, chunk_id, greatest(pos - 100, 0) AS start FROM found_at),
dense AS (SELECT s.query_id, s.chunk_id, s.start, round(sum(f.weight) + 1e-9, 6) AS total FROM starts s
          JOIN found_at f ON f.query_id = s.query_id AND f.chunk_id = s.chunk_id AND f.pos >= s.start AND f.pos < s.start + 200 GROUP BY ALL),
centre AS (SELECT query_id, chunk_id, arg_min(start, (-total, start)) + 100 AS c FROM dense GROUP BY ALL)"""
SQL_QUOTE = "replace(substr(text, CAST(greatest(c - 300, 0) AS INT) + 1, CAST(c + 300 - greatest(c - 300, 0) AS INT)), chr(10), ' ')"


@query("r5_densest_snippet", f"""WITH {sql_ranked()},{SQL_CENTRE}
SELECT b.query_id, b.rank, b.chunk_id, CASE WHEN c IS NULL THEN '[match in metadata] ' || replace(left(text, 600), chr(10), ' ') ELSE {SQL_QUOTE} END AS quote
FROM body b LEFT JOIN centre USING (query_id, chunk_id)""")
def r5(spark, d):
    w = keyword.keyword_weights(plans(spark, d), terms(spark, d))
    return keyword.with_snippets(hits(spark, d, weights=w), corpus(spark, d), w).select("query_id", "rank", "chunk_id", "quote")


SQL_KW_COUNTS = "(SELECT r.query_id, r.chunk_id, string_agg(keyword || '=' || n, ',' ORDER BY keyword) AS keyword_counts FROM ranked r JOIN kw ON kw.query_id = r.query_id JOIN counts c ON c.doc_id = r.chunk_id AND c.term = kw.keyword GROUP BY ALL)"


def _full_search(spark, d, boost):
    out = keyword.keyword_search(corpus(spark, d), terms(spark, d), plans(spark, d), 5, boost)
    listed = F.transform(F.array_sort(F.map_entries("keyword_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select(
        "query_id", "rank", "chunk_id", "source", "summary", "quote", r6("score").alias("score"),
        F.array_join(listed, ",").alias("keyword_counts"),
    )


@query("r6_keyword_search", f"""WITH {sql_ranked()},{SQL_CENTRE}
SELECT b.query_id, b.rank, b.chunk_id, b.source, 'Passage in ' || d.lang AS summary, round(b.score + 1e-9, 6) AS score, k.keyword_counts,
       CASE WHEN c IS NULL THEN '[match in metadata] ' || replace(left(b.text, 600), chr(10), ' ') ELSE {SQL_QUOTE.replace('(text', '(b.text')} END AS quote
FROM body b JOIN documents d ON d.doc_id = b.chunk_id JOIN {SQL_KW_COUNTS} k ON k.query_id = b.query_id AND k.chunk_id = b.chunk_id
LEFT JOIN centre ON centre.query_id = b.query_id AND centre.chunk_id = b.chunk_id""")
def r6_search(spark, d):
    return _full_search(spark, d, "multiply")


def _sql_heaviest(boost: str) -> str:
    return f"""WITH {sql_ranked(boost)},{SQL_SNIPPET},
centre AS (SELECT query_id, chunk_id, arg_min(pos, (-user_weight, pos)) AS c FROM found_at GROUP BY ALL)
SELECT b.query_id, b.rank, b.chunk_id, b.source, 'Passage in ' || d.lang AS summary, round(b.score + 1e-9, 6) AS score, k.keyword_counts,
       {SQL_QUOTE.replace('(text', '(b.text').replace('c - 300', 'coalesce(c, 0) - 300').replace('c + 300', 'coalesce(c, 0) + 300')} AS quote
FROM body b JOIN documents d ON d.doc_id = b.chunk_id JOIN {SQL_KW_COUNTS} k ON k.query_id = b.query_id AND k.chunk_id = b.chunk_id
LEFT JOIN centre ON centre.query_id = b.query_id AND centre.chunk_id = b.chunk_id"""


@query("r7_strict_keyword_search", _sql_heaviest("strict"))
def r7(spark, d):
    return _full_search(spark, d, "strict")


@query("r19_additive_keyword_search", _sql_heaviest("add"))
def r19(spark, d):
    return _full_search(spark, d, "add")


SQL_STOP = ", ".join(f"'{w}'" for w in keyword.stopword_set(("src",), ("up",)))


@query("r8_query_stopwords", f"""
WITH t AS (SELECT conv_id, turn, text, list_filter(list_filter(regexp_split_to_array(lower(text), '[\\t-\\r\\x1c-\\x20\\x85\\p{{Z}}]+'), lambda w: w <> ''),
           lambda w: w NOT IN ({SQL_STOP}) AND regexp_full_match(w, '[\\p{{L}}\\p{{N}}]+')) AS ws FROM conversations)
SELECT conv_id, turn, CASE WHEN len(ws) > 0 THEN array_to_string(ws, ' ') ELSE text END AS query FROM t""")
def r8(spark, d):
    words = keyword.stopword_set(("src",), ("up",))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", keyword.filtered_query(F.col("text"), words).alias("query")
    )


# ---- vectors ---------------------------------------------------------------------------------
# Queries are the mean vectors of the labels; for late interaction each label is a document
# whose token vectors are its rows, and the means of low and high labels form two queries.

SQL_CENTROIDS = """
parts AS (SELECT label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
means AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY ALL),
centroids AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY i) AS q FROM means GROUP BY label),
vecs AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def centroids(spark: SparkSession, d: str) -> DataFrame:
    return vector.mean_vectors(table(spark, d, "embeddings"), "label").select(F.col("label").cast("long").alias("query_id"), "embedding")


@query("r9_cosine_top_k", f"""WITH {SQL_CENTROIDS},
sims AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(q, v) AS s FROM centroids, vecs)
SELECT query_id, chunk_id, rank, round(s + 1e-9, 6) AS similarity FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM sims) WHERE rank <= 10""")
def r9(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return vector.cosine_top(rows, centroids(spark, d), 10).select("query_id", "chunk_id", "rank", r6("similarity").alias("similarity"))


@query("r10_answer_expansion", """
SELECT u.conv_id, u.turn, u.text || coalesce(a.text, '') AS vector_query
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def r10(spark, d):
    turns = table(spark, d, "conversations")
    drafted = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("initial_answer"))
    asked = turns.filter("role = 'user'").join(drafted, ["conv_id", "turn"], "left")
    return asked.select("conv_id", "turn", keyword.expanded_query(F.col("text"), F.col("initial_answer")).alias("vector_query"))


@query("r11_best_segment", f"""WITH {SQL_CENTROIDS},
sims AS (SELECT query_id, label AS chunk_id, vec_id AS segment_id, list_cosine_similarity(q, v) AS s FROM centroids, vecs),
hit AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, segment_id) AS rank FROM sims) WHERE rank <= 20)
SELECT query_id, chunk_id, segment_id, round(s + 1e-9, 6) AS similarity FROM
(SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round(s, 9) DESC, segment_id) AS r FROM sims JOIN hit USING (query_id, chunk_id)) WHERE r = 1""")
def r11(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("chunk_id"), F.col("vec_id").alias("segment_id"), "embedding")
    q = centroids(spark, d)
    near = vector.cosine_top(rows.select(F.col("segment_id").alias("chunk_id"), "embedding"), q, 20)
    owner = rows.select(F.col("segment_id"), F.col("chunk_id").alias("doc"))
    found = near.select("query_id", F.col("chunk_id").alias("segment_id")).join(owner, "segment_id")
    pairs = found.select("query_id", F.col("doc").alias("chunk_id")).distinct()
    return vector.best_segments(pairs, rows, q).withColumn("similarity", r6("similarity"))


@query("r12_late_interaction", f"""WITH {SQL_CENTROIDS},
toks AS (SELECT CASE WHEN query_id < 5 THEN 0 ELSE 1 END AS q_id, query_id AS token_id, q FROM centroids),
best AS (SELECT q_id, token_id, label, max(list_cosine_similarity(q, v)) AS s FROM toks, vecs GROUP BY ALL),
scores AS (SELECT CAST(q_id AS BIGINT) AS query_id, label AS chunk_id, sum(s) AS score FROM best GROUP BY ALL)
SELECT query_id, chunk_id, rank, round(score + 1e-9, 6) AS score FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scores) WHERE rank <= 5""")
def r12(spark, d):
    docs = table(spark, d, "embeddings").select(F.col("label").alias("chunk_id"), "embedding")
    tokens = centroids(spark, d).select(
        F.when(F.col("query_id") < 5, 0).otherwise(1).alias("query_id"), F.col("query_id").alias("token_id"), "embedding"
    )
    return vector.late_interaction_top(docs, tokens, 5).select("query_id", "chunk_id", "rank", r6("score").alias("score"))


# ---- fusion ----------------------------------------------------------------------------------
# Three rankings of the same events stand for the three searches: every (user, k) pair is a
# (query, text) hit, scored by its largest click, view and purchase value.

SQL_HITS = """
ev AS (SELECT user_id AS query_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, value FROM events),
asked AS (SELECT query_id, CASE WHEN k % 7 = 0 THEN k + 100000000000 ELSE k END AS text_no, event_type, value FROM ev),
one AS (SELECT query_id, 'Text #: ' || text_no AS text_id, text_no, CASE event_type WHEN 'click' THEN 'Keyword' WHEN 'view' THEN 'Semantic' ELSE 'ColBERT' END AS search_type, max(value) AS score
        FROM asked WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, search_type ORDER BY score DESC, text_no) AS rank,
         CASE WHEN search_type = 'Keyword' AND text_no % 4 <> 0 THEN 'quote ' || text_no END AS key_quote FROM one),
listed AS (SELECT *, CASE search_type WHEN 'Keyword' THEN 0 WHEN 'Semantic' THEN 1 ELSE 2 END AS ord FROM hits WHERE rank <= 10)"""


def searches(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"click": "Keyword", "view": "Semantic", "purchase": "ColBERT"}
    k = F.get_json_object("props", "$.k").cast("long")
    ev = table(spark, d, "events").select(
        F.col("user_id").alias("query_id"), F.when(k % 7 == 0, k + 100_000_000_000).otherwise(k).alias("text_no"), "event_type", "value"
    )
    parts = []
    for event, kind in kinds.items():
        best = ev.filter(F.col("event_type") == event).groupBy("query_id", "text_no").agg(F.max("value").alias("score"))
        ranked = fusion.top_n(best, ["query_id"], [F.col("score").desc(), F.col("text_no")], 10)
        row = ranked.select(
            "query_id", F.concat(F.lit("Text #: "), F.col("text_no")).alias("text_id"), "text_no",
            F.lit(kind).alias("search_type"), "score", "rank",
        )
        if kind == "Keyword":
            row = row.withColumn("key_quote", F.when(F.col("text_no") % 4 != 0, F.concat(F.lit("quote "), F.col("text_no"))))
        parts.append(row)
    return fusion.union_hits(*parts)


def _sql_dedupe(order: str) -> str:
    return f"""WITH {SQL_HITS}
SELECT query_id, text_id, search_type, rank, score, key_quote FROM
(SELECT *, row_number() OVER (PARTITION BY query_id, text_id ORDER BY {order}) AS keep FROM listed) WHERE keep = 1"""


for _policy, _order in {
    "first": "ord, rank", "score": "score DESC, ord, rank", "quoted": "key_quote IS NULL, ord, rank"
}.items():
    @query(f"r13_dedupe_{_policy}", _sql_dedupe(_order))
    def r13(spark, d, policy=_policy):
        return fusion.dedupe_hits(searches(spark, d), policy).select("query_id", "text_id", "search_type", "rank", "score", "key_quote")


SQL_KIND = "CASE WHEN trim(coalesce(given, '')) = '' OR lower(trim(given)) = 'unknown' THEN CASE WHEN key_quote IS NOT NULL THEN 'Keyword' ELSE 'Semantic' END ELSE trim(given) END"


@query("r14_provenance", f"""WITH {SQL_HITS},
g AS (SELECT *, CASE text_no % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Unknown' ELSE search_type END AS given FROM listed)
SELECT query_id, text_id, search_type AS searched, {SQL_KIND} AS search_type FROM g""")
def r14(spark, d):
    n = F.col("text_no") % 3
    given = F.when(n == 0, F.lit(None).cast("string")).when(n == 1, "Unknown").otherwise(F.col("search_type"))
    return searches(spark, d).select(
        "query_id", "text_id", F.col("search_type").alias("searched"), fusion.provenance(given, F.col("key_quote")).alias("search_type")
    )


# Every seventh hit names a text the corpus lacks and falls back to its own columns.
SQL_DOCUMENTS = f"""{SQL_HITS},
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text_id ORDER BY ord, rank) AS keep FROM listed) WHERE keep = 1),
c AS (SELECT 'Text #: ' || doc_id AS text_id, source, text AS full_text FROM documents),
docs AS (SELECT k.query_id, k.search_type, k.text_id, k.score,
  coalesce(c.source, CASE WHEN k.text_no % 2 = 0 THEN 'hit source' END, '[Source unknown]') AS source, 'summary ' || k.text_no AS summary,
  coalesce(nullif(c.full_text, ''), CASE WHEN k.search_type = 'Keyword' THEN k.key_quote ELSE 'segment ' || k.text_no END, '') AS full_text
  FROM kept k LEFT JOIN c USING (text_id))"""


def candidate_docs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("text_no")
    kept = fusion.dedupe_hits(searches(spark, d)).select(
        "query_id", "text_id", "search_type", "key_quote", F.when(n % 2 == 0, "hit source").alias("source"),
        F.concat(F.lit("summary "), n).alias("summary"), F.concat(F.lit("segment "), n).alias("top_segment"),
    )
    known = documents(spark, d).select(F.col("doc_id").alias("text_id"), "source", F.col("text").alias("full_text"))
    return fusion.candidate_documents(kept, known)


@query("r15_candidate_documents", f"""WITH {SQL_DOCUMENTS}
SELECT query_id, text_id, search_type, source, summary, full_text,
       to_json({{'search_type': search_type, 'text_id': text_id, 'source': source, 'summary': summary, 'full_text': full_text}})::VARCHAR AS document FROM docs""")
def r15(spark, d):
    return candidate_docs(spark, d)


def relevance_scores(spark: SparkSession, d: str) -> DataFrame:
    """Relevance in [0, 1) from the text number, in place of an external model."""
    n = F.regexp_extract("text_id", r"(\d+)", 1).cast("long")
    value = ((n * 37 + F.col("query_id") * 11) % 101) / 101.0
    return searches(spark, d).select("query_id", "text_id").distinct().withColumn("relevance", value)


SQL_RERANKED = f"""{SQL_DOCUMENTS},
rel AS (SELECT *, ((CAST(substr(text_id, 9) AS BIGINT) * 37 + query_id * 11) % 101) / 101.0 AS relevance FROM docs),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, text_id) AS rank FROM rel) WHERE rank <= 15)"""


def reranked(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rerank(candidate_docs(spark, d).drop("document"), relevance_scores(spark, d), 15)


@query("r16_rerank_top_n", f"""WITH {SQL_RERANKED}
SELECT query_id, rank, search_type, text_id, source, summary, full_text AS key_quote, round(relevance + 1e-9, 6) AS relevance FROM top""")
def r16(spark, d):
    return reranked(spark, d).select(
        "query_id", "rank", "search_type", "text_id", "source", "summary", F.col("full_text").alias("key_quote"), r6("relevance").alias("relevance")
    )


@query("r17_context_format", f"""WITH {SQL_RERANKED},
e AS (SELECT query_id, rank, 'Match ' || rank || ': Search Type - ' || search_type || ', Text ID - ' || text_id || ', Source - ' || source
 || ', Summary (curatorial description only — not quotable corpus text) - ' || summary
 || ', Full Text (select the most relevant passage to quote directly) - ' || full_text || ', Relevance Score - ' || format('{{:.2f}}', relevance) AS entry FROM top WHERE rank <= 5)
SELECT u.query_id, coalesce(string_agg(entry, chr(10) || chr(10) ORDER BY rank), 'No results to format') AS context
FROM (SELECT DISTINCT user_id AS query_id FROM events) u LEFT JOIN e USING (query_id) GROUP BY u.query_id""")
def r17(spark, d):
    asked = table(spark, d, "events").select(F.col("user_id").alias("query_id")).distinct()
    return fusion.contexts_for(asked, fusion.formatted_context(reranked(spark, d)))


@query("r18_id_remap", """
WITH c AS (SELECT doc_id, source FROM documents),
h AS (SELECT doc_id * 2 AS doc_id, CASE WHEN lang = 'de' THEN 'unknown' ELSE trim(source) END AS source FROM documents),
f AS (SELECT source, min(doc_id) AS first FROM c GROUP BY source)
SELECT h.doc_id, CASE WHEN c.doc_id IS NULL AND f.first IS NOT NULL THEN f.first ELSE h.doc_id END AS final_id,
  CASE WHEN c.doc_id IS NOT NULL THEN '' WHEN f.first IS NOT NULL THEN 'source_match' ELSE 'missing_in_corpus_no_source_match' END AS remap_reason,
  c.doc_id IS NULL AND f.first IS NOT NULL AND f.first <> h.doc_id AS remapped, c.doc_id IS NOT NULL AS parsed_in_corpus,
  c.doc_id IS NOT NULL OR f.first IS NOT NULL AS final_in_corpus
FROM h LEFT JOIN c ON c.doc_id = h.doc_id LEFT JOIN f ON f.source = h.source""")
def r18(spark, d):
    docs = documents(spark, d)
    known = docs.select(F.col("doc_id").alias("chunk_id"), "source")
    label = F.when(F.col("lang") == "de", "unknown").otherwise(F.concat(F.col("source"), F.lit(" ")))
    asked = F.col("doc_id") * 2  # half of them the corpus lacks
    rows = docs.select(asked.alias("doc_id"), F.concat(F.lit("Text #: "), asked).alias("text_id"), label.alias("source"))
    return fusion.remap_ids(rows, known).select("doc_id", "final_id", "remap_reason", "remapped", "parsed_in_corpus", "final_in_corpus")


@query("r20_manual_override", f"""
WITH kw AS (SELECT item_id, {sql_runs('text')} AS ws FROM benchmark),
m AS (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN ws[1] END AS mine FROM kw)
SELECT item_id AS query_id, coalesce(mine, array_to_string(list_sort(list_distinct(ws)), ',')) AS keywords,
  CASE WHEN mine IS NOT NULL THEN '1863' WHEN item_id % 2 = 1 THEN CAST(item_id % 7 AS VARCHAR) ELSE '' END AS years,
  CASE WHEN mine IS NOT NULL THEN '' WHEN item_id % 3 = 0 THEN 'Source: src' || (item_id % 20) ELSE '' END AS texts
FROM kw JOIN m USING (item_id)""")
def r20(spark, d):
    p = plans(spark, d)
    first = F.element_at(tx.word_runs(F.col("query")), 1)
    manual = p.select(
        "query_id", F.when(F.col("query_id") % 4 == 0, F.create_map(first, F.lit(5.0))).alias("weighted_keywords"),
        F.array(F.lit(1863)).alias("year_keywords"), F.array().cast("array<string>").alias("text_keywords"),
    )
    return keyword.override_keywords(p, manual).select(
        "query_id", F.array_join(F.array_sort(F.map_keys("weighted_keywords")), ",").alias("keywords"),
        F.array_join(F.col("year_keywords").cast("array<string>"), ",").alias("years"), F.array_join("text_keywords", ",").alias("texts"),
    )
