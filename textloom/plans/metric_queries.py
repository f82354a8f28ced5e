"""Registered queries: retrieval metrics and text-overlap scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import stem, text as tx
from textloom.operators import containment, irmetrics, overlap
from textloom.plans.prep_queries import documents
from textloom.plans.registry import query, r6, sql_runs, sql_words, table
from textloom.plans.retrieval_queries import SQL_RERANKED, hits, reranked, sql_ranked
from textloom.session import cut_lineage

# ---- keyword hits of benchmark items against the documents containing them ---------------------

SQL_QRELS = "qrels AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def qrels(spark: SparkSession, d: str) -> DataFrame:
    found = containment.containment_join(table(spark, d, "benchmark"), "item_id", "text", documents(spark, d), "doc_id", "text")
    return found.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"))


SQL_MARKED = f"""{sql_ranked(n=10)}, {SQL_QRELS},
marked AS (SELECT r.query_id, r.chunk_id, r.rank, q.chunk_id IS NOT NULL AS rel FROM ranked r LEFT JOIN qrels q USING (query_id, chunk_id)),
sizes AS (SELECT query_id, count(*) AS n_ideal FROM qrels GROUP BY 1),
ret AS (SELECT query_id, count(*) AS n_retrieved, count(*) FILTER (rel) AS n_hit FROM marked GROUP BY 1)"""


@query("m1_precision_recall", f"""WITH {SQL_MARKED},
j AS (SELECT query_id, coalesce(n_retrieved, 0) AS n_retrieved, coalesce(n_hit, 0) AS n_hit, coalesce(n_ideal, 0) AS n_ideal FROM ret FULL JOIN sizes USING (query_id))
SELECT query_id, n_retrieved, n_hit, n_ideal, n_ideal - n_hit AS n_missed, round(CASE WHEN n_retrieved > 0 THEN n_hit / n_retrieved ELSE 0 END, 4) AS precision,
 round(CASE WHEN n_ideal > 0 THEN n_hit / n_ideal ELSE 0 END, 4) AS recall,
 round(CASE WHEN n_retrieved > 0 AND n_ideal > 0 THEN (n_hit / n_retrieved) / (least(n_ideal, n_retrieved) / n_retrieved) ELSE 0 END, 4) AS ceiling_precision FROM j""")
def m1(spark, d):
    return irmetrics.precision_recall(hits(spark, d, 10), qrels(spark, d))


@query("m1_hit_and_miss_ids", f"""WITH {SQL_MARKED}
SELECT q.query_id, q.chunk_id, CASE WHEN r.chunk_id IS NOT NULL THEN 'hit' ELSE 'missed' END AS status FROM qrels q LEFT JOIN ranked r USING (query_id, chunk_id)""")
def m1_ids(spark, d):
    return irmetrics.hit_and_miss(hits(spark, d, 10), qrels(spark, d))


SQL_RANKING = """
m AS (SELECT query_id, coalesce(1 / min(rank) FILTER (rel), 0) AS mrr, count(*) AS n, count(*) FILTER (rel) AS n_rel,
      coalesce(sum(1 / log2(rank + 1)) FILTER (rel), 0) AS dcg, count(*) FILTER (rel AND rank <= 1) AS t1,
      count(*) FILTER (rel AND rank <= 3) AS t3, count(*) FILTER (rel AND rank <= 5) AS t5 FROM marked GROUP BY query_id),
g AS (SELECT m.*, coalesce(n_ideal, 0) AS n_ideal, least(coalesce(n_ideal, 0), n) AS best FROM m LEFT JOIN sizes USING (query_id)),
f AS (SELECT *, list_sum(list_transform(range(1, best + 1), lambda i: 1 / log2(i + 1))) AS top,
             list_sum(list_transform(range(1, n_rel + 1), lambda i: 1 / log2(i + 1))) AS top_retrieved FROM g)"""


@query("m3_reciprocal_rank", f"WITH {SQL_MARKED}, {SQL_RANKING} SELECT query_id, round(mrr + 1e-9, 6) AS mrr FROM f")
def m3(spark, d):
    return irmetrics.ranking_metrics(hits(spark, d, 10), qrels(spark, d)).select("query_id", r6("mrr").alias("mrr"))


@query("m4_ndcg", f"""WITH {SQL_MARKED}, {SQL_RANKING}
SELECT query_id, round(CASE WHEN best > 0 THEN dcg / top ELSE 0 END + 1e-9, 6) AS ndcg, round(CASE WHEN n_rel > 0 THEN dcg / top_retrieved ELSE 0 END + 1e-9, 6) AS ndcg_retrieved FROM f""")
def m4(spark, d):
    h, q = cut_lineage(hits(spark, d, 10), "hits"), cut_lineage(qrels(spark, d), "qrels")
    full = irmetrics.ranking_metrics(h, q).select("query_id", r6("ndcg").alias("ndcg"))
    own = irmetrics.ranking_metrics(h, q, ideal="retrieved").select("query_id", r6("ndcg").alias("ndcg_retrieved"))
    return full.join(own, "query_id")


@query("m5_precision_recall_at_k", f"""WITH {SQL_MARKED}, {SQL_RANKING}
SELECT query_id, {', '.join(f"round(t{k} / {k} + 1e-9, 6) AS p_at_{k}, round(CASE WHEN n_ideal > 0 THEN t{k} / n_ideal ELSE 0 END + 1e-9, 6) AS r_at_{k}" for k in (1, 3, 5))} FROM f""")
def m5(spark, d):
    m = irmetrics.ranking_metrics(hits(spark, d, 10), qrels(spark, d))
    cols = [f"{x}_at_{k}" for k in (1, 3, 5) for x in ("p", "r")]
    return m.select("query_id", *[r6(c).alias(c) for c in cols])


# ---- reranked event hits: ideal texts are those a user signed up for, or (original set) met errors with ----


def event_qrels(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").filter("event_type in ('signup', 'error')")
    kind = F.when(F.col("event_type") == "signup", "new").otherwise("original")
    return ev.select(
        F.col("user_id").alias("query_id"), F.get_json_object("props", "$.k").cast("long").alias("chunk_id"), kind.alias("id_set"), "value"
    ).filter("id_set = 'new' or value > 20").drop("value").distinct()


def event_hits(spark: SparkSession, d: str) -> DataFrame:
    return reranked(spark, d).select(
        "query_id", tx.id_number(F.col("text_id")).alias("chunk_id"), "rank", "search_type", "source", F.col("relevance").alias("score")
    )


SQL_EVENT = f"""{SQL_RERANKED},
h AS (SELECT query_id, CAST(substr(text_id, 9) AS BIGINT) AS chunk_id, rank, search_type, source, relevance AS score FROM top),
allq AS (SELECT DISTINCT user_id AS query_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS chunk_id, CASE event_type WHEN 'signup' THEN 'new' ELSE 'original' END AS id_set
         FROM events WHERE event_type = 'signup' OR (event_type = 'error' AND value > 20)),
pick AS (SELECT h.query_id, CASE WHEN bool_or(q.chunk_id IS NOT NULL) THEN 'original' ELSE 'new' END AS id_set
         FROM h LEFT JOIN (SELECT * FROM allq WHERE id_set = 'original') q USING (query_id, chunk_id) GROUP BY h.query_id)"""


@query("m2_id_set_detection", f"""WITH {SQL_EVENT}
SELECT a.query_id, a.chunk_id, a.id_set FROM allq a LEFT JOIN pick p ON p.query_id = a.query_id WHERE a.id_set = coalesce(p.id_set, 'new')""")
def m2(spark, d):
    return irmetrics.chosen_qrels(event_hits(spark, d), event_qrels(spark, d))


def _sql_by_type(kind: str) -> str:
    return f"""SELECT '{kind}' AS search_type, query_id, round(coalesce(1 / min(rank) FILTER (rel), 0) + 1e-9, 6) AS mrr,
 round(count(*) FILTER (rel AND rank <= 3) / 3 + 1e-9, 6) AS p_at_3, round(coalesce(count(*) FILTER (rel AND rank <= 3) / max(n_ideal), 0) + 1e-9, 6) AS r_at_3
FROM (SELECT t.query_id, t.rank, q.chunk_id IS NOT NULL AS rel, s.n_ideal FROM
   (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM h WHERE search_type = '{kind}') t
   LEFT JOIN nq q USING (query_id, chunk_id) LEFT JOIN (SELECT query_id, count(*) AS n_ideal FROM nq GROUP BY 1) s ON s.query_id = t.query_id) GROUP BY query_id"""


@query("m6_metrics_by_search_type", f"""WITH {SQL_EVENT}, nq AS (SELECT query_id, chunk_id FROM allq WHERE id_set = 'new')
{_sql_by_type('Keyword')} UNION ALL {_sql_by_type('Semantic')}""")
def m6(spark, d):
    q = event_qrels(spark, d).filter("id_set = 'new'").select("query_id", "chunk_id")
    m = irmetrics.metrics_by_search(event_hits(spark, d), q)
    return m.select("search_type", "query_id", *[r6(c).alias(c) for c in ("mrr", "p_at_3", "r_at_3")])


@query("m7_path_composition", f"""WITH {SQL_EVENT}
SELECT query_id, string_agg(search_type, ',' ORDER BY rank) AS path, count(*) FILTER (search_type = 'Keyword') AS n_keyword,
 count(*) FILTER (search_type = 'Semantic') AS n_semantic FROM h WHERE rank <= 5 GROUP BY query_id""")
def m7(spark, d):
    return irmetrics.path_composition(event_hits(spark, d))


@query("m8_score_profile", f"""WITH {SQL_EVENT},
p AS (SELECT query_id, max(score) AS hi, min(score) AS lo, avg(score) AS mean, count(DISTINCT source) AS n_src FROM h WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, round(hi, 6) AS score_max, round(lo, 6) AS score_min, round(mean, 6) AS score_mean, round(hi - lo, 4) AS spread, n_src AS n_sources,
 hi >= 0.70 AND round(hi - lo, 4) <= 0.08 AS calibration_warning FROM p""")
def m8(spark, d):
    return irmetrics.score_profile(event_hits(spark, d))


@query("m9_source_diversity", f"""WITH {SQL_EVENT}
SELECT h.query_id, CASE WHEN count(DISTINCT d.source) > 0 THEN count(DISTINCT d.source) ELSE count(*) END AS n_sources
FROM h LEFT JOIN documents d ON d.doc_id = h.chunk_id GROUP BY h.query_id""")
def m9(spark, d):
    known = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "source")
    return irmetrics.source_diversity(event_hits(spark, d), known)


@query("m10_expected_overlap", f"""WITH {SQL_EVENT}, nq AS (SELECT query_id, chunk_id FROM allq WHERE id_set = 'new'),
t AS (SELECT query_id, chunk_id FROM h WHERE rank <= 3)
SELECT coalesce(t.query_id, nq.query_id) AS query_id, count(*) FILTER (t.chunk_id IS NOT NULL AND nq.chunk_id IS NOT NULL) AS n_matched,
 count(nq.chunk_id) AS n_expected, count(t.chunk_id) AS n_retrieved
FROM t FULL JOIN nq ON t.query_id = nq.query_id AND t.chunk_id = nq.chunk_id GROUP BY 1""")
def m10(spark, d):
    q = event_qrels(spark, d).filter("id_set = 'new'").select("query_id", "chunk_id")
    return irmetrics.expected_overlap(event_hits(spark, d), q)


# ---- overlap scores: every answer of a conversation against the turn before it ------------------

SQL_PAIRS = """
pairs AS (SELECT a.conv_id || ':' || a.turn AS pair_id, a.text AS candidate, u.text AS reference
          FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant')"""


def answer_pairs(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    answers = turns.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("candidate"))
    return answers.join(asked, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("pair_id"), "candidate", "reference")


def sql_grams(tokens, orders: tuple[int, ...] = (1, 2, 3, 4), suffix: str = "") -> str:
    """Clipped n-gram overlap per pair and order: ``ov(pair_id, n, clipped, nc, nr)``."""
    x = suffix
    leads = "".join(f", lead(w, {k}) OVER (PARTITION BY pair_id, side ORDER BY i) AS w{k}" for k in range(1, max(orders)))
    grams = " UNION ALL ".join(
        f"SELECT pair_id, side, {n} AS n, w{''.join(f' || {chr(39)} {chr(39)} || w{k}' for k in range(1, n))} AS g FROM ld{x}"
        + (f" WHERE w{n - 1} IS NOT NULL" if n > 1 else "")
        for n in orders
    )
    return f"""
tk{x} AS (SELECT pair_id, 'c' AS side, {tokens('candidate')} AS t FROM pairs UNION ALL SELECT pair_id, 'r', {tokens('reference')} FROM pairs),
un{x} AS (SELECT pair_id, side, unnest(range(len(t))) AS i, unnest(t) AS w FROM tk{x}),
ld{x} AS (SELECT pair_id, side, w{leads} FROM un{x}),
gr{x} AS ({grams}),
gc{x} AS (SELECT pair_id, n, g, count(*) FILTER (side = 'c') AS c, count(*) FILTER (side = 'r') AS r FROM gr{x} GROUP BY ALL),
ov{x} AS (SELECT pair_id, n, sum(least(c, r)) AS clipped, sum(c) AS nc, sum(r) AS nr FROM gc{x} GROUP BY ALL)"""


def sql_bleu(smooth: bool) -> str:
    parts = []
    for n in (1, 2, 3, 4):
        low = f"0.1 / greatest(coalesce(max(nc) FILTER (n = {n}), 0), 1)" if smooth else "0"
        parts.append(f"CASE WHEN max(clipped) FILTER (n = {n}) > 0 THEN max(clipped) FILTER (n = {n}) / max(nc) FILTER (n = {n}) ELSE {low} END AS p{n}")
    return f"""
bl AS (SELECT pair_id, coalesce(max(nc) FILTER (n = 1), 0) AS hyp, coalesce(max(nr) FILTER (n = 1), 0) AS ref, coalesce(max(clipped) FILTER (n = 1), 0) AS k1, {', '.join(parts)} FROM ov GROUP BY pair_id),
bleu AS (SELECT pair_id, CASE WHEN k1 = 0 OR least(p1, p2, p3, p4) = 0 THEN 0 ELSE
   (CASE WHEN hyp > ref THEN 1 ELSE exp(1 - ref / hyp) END) * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) END AS bleu FROM bl)"""


def sql_overlap(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '[a-z0-9]+')"


def sql_stems(e: str) -> str:
    return f"list_transform({sql_overlap(e)}, lambda w: CASE WHEN length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END)"


def sql_f1(n: int) -> str:
    return f"coalesce(max(CASE WHEN n = {n} AND clipped > 0 THEN 2.0 * clipped / (nc + nr) END), 0)"


@query("b1_bleu", f"""WITH {SQL_PAIRS},{sql_grams(sql_words)},{sql_bleu(False)}
SELECT p.pair_id, round(coalesce(bleu, 0) + 1e-9, 6) AS bleu FROM pairs p LEFT JOIN bleu USING (pair_id)""")
def b1(spark, d):
    return overlap.bleu(answer_pairs(spark, d)).withColumn("bleu", r6("bleu"))


@query("b1_bleu_smoothed", f"""WITH {SQL_PAIRS},{sql_grams(sql_runs)},{sql_bleu(True)}
SELECT p.pair_id, round(coalesce(bleu, 0) + 1e-9, 6) AS bleu FROM pairs p LEFT JOIN bleu USING (pair_id)""")
def b1_smoothed(spark, d):
    return overlap.bleu(answer_pairs(spark, d), True, "words").withColumn("bleu", r6("bleu"))


@query("b2_rouge", f"""WITH {SQL_PAIRS},{sql_grams(sql_overlap, orders=(1, 2))}
SELECT p.pair_id, round(coalesce(r1, 0) + 1e-9, 6) AS rouge1, round(coalesce(r2, 0) + 1e-9, 6) AS rouge2 FROM pairs p
LEFT JOIN (SELECT pair_id, {sql_f1(1)} AS r1, {sql_f1(2)} AS r2 FROM ov GROUP BY pair_id) USING (pair_id)""")
def b2(spark, d):
    return overlap.rouge(answer_pairs(spark, d)).select("pair_id", r6("rouge1").alias("rouge1"), r6("rouge2").alias("rouge2"))


# Stems here: words over three letters lose a final s.
@query("b2_rouge_stemmed", f"""WITH {SQL_PAIRS},{sql_grams(sql_stems, orders=(1, 2))}
SELECT p.pair_id, round(coalesce(r1, 0) + 1e-9, 6) AS rouge1, round(coalesce(r2, 0) + 1e-9, 6) AS rouge2 FROM pairs p
LEFT JOIN (SELECT pair_id, {sql_f1(1)} AS r1, {sql_f1(2)} AS r2 FROM ov GROUP BY pair_id) USING (pair_id)""")
def b2_stemmed(spark, d):
    pairs = answer_pairs(spark, d)
    words = pairs.select(F.explode(F.concat(overlap.overlap_tokens(F.col("candidate")), overlap.overlap_tokens(F.col("reference")))).alias("token"))
    stems = words.filter("token like '%s'").distinct().withColumn("stem", F.regexp_replace("token", "s$", ""))
    return overlap.rouge(pairs, stems=stems).select("pair_id", r6("rouge1").alias("rouge1"), r6("rouge2").alias("rouge2"))


def _sql_swapped(before: str, after: str, suffixes: dict[str, str], least: str) -> str:
    longest_first = "|".join(sorted(suffixes, key=len, reverse=True))
    new = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in suffixes.items())
    ion = "AND (e <> 'ion' OR regexp_matches(r, '[st]$'))" if "ion" in suffixes else ""
    return f"""
{after} AS (SELECT token, CASE WHEN e <> '' AND regexp_matches(r, '{least}') {ion} THEN r || CASE e {new} END ELSE w END AS w
  FROM (SELECT *, w[:length(w) - length(e)] AS r FROM (SELECT *, regexp_extract(w, '({longest_first})$', 1) AS e FROM {before})))"""


# The steps of the stemming algorithm over the distinct words; un(w) are all words.
SQL_PORTER = f"""
p0 AS (SELECT token, regexp_replace(regexp_replace(token, '(^|[aeiou])y', '\1Y', 'g'), 'yy', 'yY', 'g') AS w FROM (SELECT DISTINCT w AS token FROM un WHERE length(w) > 3)),
p1 AS (SELECT token, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN w[:-3] WHEN regexp_matches(w, '[^s]s$') THEN w[:-2] ELSE w END AS w FROM p0),
p2 AS (SELECT token, CASE WHEN e = 'eed' AND regexp_matches(r, '{stem.ONE}') THEN w[:-2] WHEN e IN ('ed', 'ing') AND regexp_matches(r, '{stem.HAS_VOWEL}') THEN
    CASE WHEN regexp_matches(r, '(at|bl|iz)$') THEN r || 'e' WHEN length(r) > 1 AND r[-1] = r[-2] AND NOT regexp_matches(r, '[aeiouylsz]$') OR r LIKE '%yY' THEN r[:-2]
         WHEN regexp_matches(r, '{stem.JUST_ONE}') AND regexp_matches(r, '{stem.SHORT_END}') THEN r || 'e' ELSE r END ELSE w END AS w
  FROM (SELECT *, w[:length(w) - length(e)] AS r FROM (SELECT *, regexp_extract(w, '(eed|ed|ing)$', 1) AS e FROM p1))),
p3 AS (SELECT token, CASE WHEN regexp_matches(w, '{stem.HAS_VOWEL}.*[yY]$') THEN w[:-2] || 'i' ELSE w END AS w FROM p2),
{_sql_swapped('p3', 'p4', stem.SECOND, stem.ONE)},{_sql_swapped('p4', 'p5', stem.THIRD, stem.ONE)},{_sql_swapped('p5', 'p6', stem.FOURTH, stem.TWO)},
p7 AS (SELECT token, CASE WHEN w LIKE '%e' AND (regexp_matches(w[:-2], '{stem.TWO}') OR regexp_matches(w[:-2], '{stem.JUST_ONE}') AND NOT regexp_matches(w[:-2], '{stem.SHORT_END}')) THEN w[:-2] ELSE w END AS w FROM p6),
p8 AS (SELECT token, lower(CASE WHEN w LIKE '%ll' AND regexp_matches(w, '{stem.TWO}') THEN w[:-2] ELSE w END) AS stem FROM p7),
st AS (SELECT pair_id, side, i, coalesce(stem, w) AS w FROM un LEFT JOIN p8 ON token = w)"""
SQL_PORTER_GRAMS = sql_grams(sql_overlap, orders=(1, 2)).replace("ld AS (", f"{SQL_PORTER.strip()},\nld AS (").replace("FROM un),", "FROM st),")


@query("b2_rouge_porter", f"""WITH {SQL_PAIRS},{SQL_PORTER_GRAMS}
SELECT p.pair_id, round(coalesce(r1, 0) + 1e-9, 6) AS rouge1, round(coalesce(r2, 0) + 1e-9, 6) AS rouge2 FROM pairs p
LEFT JOIN (SELECT pair_id, {sql_f1(1)} AS r1, {sql_f1(2)} AS r2 FROM ov GROUP BY pair_id) USING (pair_id)""")
def b2_porter(spark, d):
    pairs = answer_pairs(spark, d)
    return overlap.rouge(pairs, stems=overlap.english_stems(pairs)).select("pair_id", r6("rouge1").alias("rouge1"), r6("rouge2").alias("rouge2"))


# Longest common subsequence, one word of the answer after the other: a cell is the largest of the cells above
# and, where the words agree, of those before plus one.
@query("b3_rouge_l", f"""WITH RECURSIVE {SQL_PAIRS.strip()},
t AS (SELECT pair_id, {sql_overlap('candidate')} AS a, {sql_overlap('reference')} AS b FROM pairs),
r AS (SELECT pair_id, 0 AS i, a, b, list_transform(b, lambda x: 0) AS above FROM t
  UNION ALL SELECT pair_id, i + 1, a, b, list_transform(v, lambda x, j: list_max(v[1:j]))
  FROM (SELECT *, list_transform(b, lambda x, j: greatest(above[j], CASE WHEN j > 1 THEN above[j - 1] ELSE 0 END + (x = a[i + 1])::INTEGER)) AS v
        FROM r WHERE i < len(a)))
SELECT pair_id, round(CASE WHEN n > 0 THEN 2 * (n / len(a)) * (n / len(b)) / (n / len(a) + n / len(b)) ELSE 0 END + 1e-9, 6) AS rouge_l
FROM (SELECT pair_id, a, b, coalesce(above[len(b)], 0) AS n FROM r WHERE i = len(a))""")
def b3(spark, d):
    return overlap.rouge_l(answer_pairs(spark, d)).withColumn("rouge_l", r6("rouge_l"))


# Benchmark items as answers, against their keyword hits (retrieved) and the documents containing them (ideal).
def reference_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = hits(spark, d).select("query_id", "chunk_id", F.lit("retrieved").alias("ref_set")).unionByName(
        qrels(spark, d).withColumn("ref_set", F.lit("ideal"))
    )
    answers = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("candidate"))
    docs = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("reference"))
    pairs = found.join(answers, "query_id").join(docs, "chunk_id").withColumn("pair_id", F.concat_ws(":", "ref_set", "query_id", "chunk_id"))
    return cut_lineage(pairs, "reference-pairs")


SQL_SETS = f"""{sql_ranked()}, {SQL_QRELS},
refs AS (SELECT query_id, chunk_id, 'retrieved' AS ref_set FROM ranked UNION ALL SELECT query_id, chunk_id, 'ideal' FROM qrels),
pairs AS (SELECT ref_set || ':' || query_id || ':' || chunk_id AS pair_id, query_id, ref_set, b.text AS candidate, d.text AS reference
          FROM refs JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = chunk_id)"""


def _sql_stats(col: str, digits: int = 4) -> str:
    return ", ".join(
        f"round(max({col}) FILTER (ref_set = '{s}'), {digits}) AS {col}_max_{s}, round(avg({col}) FILTER (ref_set = '{s}'), {digits}) AS {col}_avg_{s}"
        for s in ("retrieved", "ideal")
    )


@query("b4_rouge_by_reference_set", f"""WITH {SQL_SETS},{sql_grams(sql_overlap, orders=(1, 2))},
s AS (SELECT p.query_id, p.ref_set, coalesce(r1, 0) AS rouge1, coalesce(r2, 0) AS rouge2 FROM pairs p LEFT JOIN (SELECT pair_id, {sql_f1(1)} AS r1, {sql_f1(2)} AS r2 FROM ov GROUP BY pair_id) USING (pair_id)),
g AS (SELECT query_id, {_sql_stats('rouge1')}, {_sql_stats('rouge2')} FROM s GROUP BY query_id)
SELECT *, CASE WHEN coalesce(rouge1_avg_ideal, 0) > 0 THEN round(coalesce(rouge1_avg_retrieved, 0) / rouge1_avg_ideal, 3) END AS rouge1_ratio FROM g""")
def b4(spark, d):
    pairs = reference_pairs(spark, d)
    scores = pairs.select("pair_id", "query_id", "ref_set").join(overlap.rouge(pairs), "pair_id")
    return overlap.compare_reference_sets(pairs, scores)


@query("b4_bleu_by_reference_set", f"""WITH {SQL_SETS},{sql_grams(sql_runs)},{sql_bleu(True)},
s AS (SELECT p.query_id, p.ref_set, coalesce(bleu, 0) AS bleu FROM pairs p LEFT JOIN bleu USING (pair_id))
SELECT query_id, {_sql_stats('bleu')} FROM s GROUP BY query_id""")
def b4_bleu(spark, d):
    pairs = reference_pairs(spark, d)
    scores = pairs.select("pair_id", "query_id", "ref_set").join(overlap.bleu(pairs, True, "words"), "pair_id")
    rows = scores.withColumn("rouge1", F.lit(None).cast("double"))
    return overlap.compare_reference_sets(pairs, rows).select(
        "query_id", *[f"bleu_{a}_{s}" for s in ("retrieved", "ideal") for a in ("max", "avg")]
    )


@query("b4_all_scores")
def b4_all(spark, d):
    return overlap.compare_reference_sets(reference_pairs(spark, d))


SQL_ANSWERS = f"""{SQL_RERANKED},
an AS (SELECT conv_id AS query_id, arg_min(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
t3 AS (SELECT query_id, rank, CAST(substr(text_id, 9) AS BIGINT) AS chunk_id, full_text AS reference FROM top WHERE rank <= 3),
u AS (SELECT * FROM t3 UNION ALL SELECT query_id, 0, NULL, string_agg(reference, ' ' ORDER BY rank) FROM t3 GROUP BY query_id),
pairs AS (SELECT query_id || ':' || rank AS pair_id, query_id, rank, chunk_id, answer AS candidate, reference FROM u JOIN an USING (query_id))"""


def evaluated_answers(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "conversations").filter("role = 'assistant'").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.min_by("text", "turn").alias("answer")
    )
    ranked = reranked(spark, d).select("query_id", "rank", tx.id_number(F.col("text_id")).alias("chunk_id"), F.col("full_text").alias("key_quote"))
    return overlap.answer_evaluation(answers, ranked)


@query("b5_answer_evaluation", f"""WITH {SQL_ANSWERS},{sql_grams(sql_words)},{sql_bleu(False)},{sql_grams(sql_overlap, (1,), '2')}
SELECT p.query_id, p.rank, p.chunk_id, length(p.reference) AS reference_length, length(p.candidate) AS answer_length,
       round(coalesce(bleu, 0) + 1e-9, 6) AS bleu, round(coalesce(r1, 0) + 1e-9, 6) AS rouge1
FROM pairs p LEFT JOIN bleu USING (pair_id) LEFT JOIN (SELECT pair_id, {sql_f1(1)} AS r1 FROM ov2 GROUP BY pair_id) USING (pair_id)""")
def b5(spark, d):
    return evaluated_answers(spark, d).select(
        "query_id", "rank", "chunk_id", "reference_length", "answer_length", r6("bleu").alias("bleu"), r6("rouge1").alias("rouge1")
    )
