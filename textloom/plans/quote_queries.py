"""Registered queries: quote verification.

Quotes are the benchmark items (citing the document of the same number) and all sentences of every
labelled document: verbatim, in capitals, without commas, or with one word replaced; citing that
document or the next one.
"""

from __future__ import annotations

import unicodedata
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.functions import text as tx
from textloom.operators import quotes
from textloom.operators.skew import keep_ids
from textloom.plans.prep_queries import documents
from textloom.plans.registry import query, r6, sql_sentences, sql_squeeze, sql_strip, sql_words, table

# The letters of the test texts that NFKD decomposes.
ACCENTED = "éèêçüäöóñí"


def sql_decomposed(e: str) -> str:
    for ch in ACCENTED + ACCENTED.upper():
        e = f"replace({e}, '{ch}', '{unicodedata.normalize('NFKD', ch)}')"
    return e


def sql_strict(e: str) -> str:
    """Strict form of decomposed text. A run of quote marks survives only single and between word characters."""
    e = f"replace(replace({e}, '``', '\"'), '''''', '\"')"
    e = f"translate({e}, '`‘’“”', '''''''\"\"')"
    e = rf"regexp_replace(replace({e}, '…', '...'), '\\n|[\n\r]', ' ', 'g')"
    e = rf"regexp_replace(regexp_replace({e}, '[-–—]+', ' ', 'g'), '\[.*?\]', '', 'g')"
    e = f"lower({sql_squeeze(e)})"
    e = f"regexp_replace({e}, '[\"'']{{2,}}', '', 'g')"
    e = rf"regexp_replace({e}, '(^|[^\p{{L}}\p{{N}}_])[\"'']', '\1', 'g')"
    return rf"regexp_replace({e}, '[\"'']([^\p{{L}}\p{{N}}_]|$)', '\1', 'g')"


def sql_loose(strict: str) -> str:
    return sql_squeeze(f"regexp_replace({strict}, '[^0-9a-z]', ' ', 'g')")


SQL_QUOTES = f"""
found AS (SELECT d.doc_id, l.quality, {sql_sentences('text')} AS found FROM labels l JOIN documents d USING (doc_id)),
s AS (SELECT doc_id, quality, unnest(found) AS s2, generate_subscripts(found, 1) AS place FROM found),
w AS (SELECT *, {sql_words('s2')} AS ws FROM s WHERE s2 IS NOT NULL),
quotes AS (SELECT 'b' || item_id AS quote_id, text AS passage, item_id AS cited FROM benchmark
  UNION ALL SELECT 'l' || doc_id || 's' || place, CASE WHEN doc_id % 4 = 1 THEN translate(s2, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN doc_id % 4 = 2 THEN '“' || replace(s2, ',', '') || '...'
     WHEN doc_id % 4 = 3 AND len(ws) > 4 THEN array_to_string(list_transform(ws, lambda x, i: CASE WHEN i = len(ws) - 2 THEN 'zzyzx' ELSE x END), ' ') ELSE s2 END,
     CASE WHEN quality = 1 THEN doc_id ELSE doc_id + 1 END FROM w)"""


def quote_table(spark: SparkSession, d: str) -> DataFrame:
    """The quotes of the SQL: sentences are named by document and place."""
    doc = F.col("doc_id")
    rows = table(spark, d, "labels").join(documents(spark, d), "doc_id").select(
        "doc_id", "quality", F.posexplode(tx.sentences(F.col("text"))).alias("place", "s2")
    )
    rows = rows.filter("s2 is not null").withColumn("ws", tx.split_words(F.col("s2")))
    name = F.concat(F.lit("l"), doc, F.lit("s"), F.col("place") + 1)
    swapped = F.transform("ws", lambda x, i: F.when(i == F.size("ws") - 3, "zzyzx").otherwise(x))
    passage = (
        F.when(doc % 4 == 1, F.translate("s2", ascii_lowercase, ascii_uppercase))
        .when(doc % 4 == 2, F.concat(F.lit("“"), F.replace("s2", F.lit(","), F.lit("")), F.lit("...")))
        .when((doc % 4 == 3) & (F.size("ws") > 4), F.array_join(swapped, " "))
        .otherwise(F.col("s2"))
    )
    cited = F.when(F.col("quality") == 1, doc).otherwise(doc + 1)
    mine = rows.select(name.alias("quote_id"), passage.alias("passage"), cited.alias("cited"))
    given = table(spark, d, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id")).alias("quote_id"), F.col("text").alias("passage"), F.col("item_id").alias("cited")
    )
    return given.unionByName(mine)


SQL_STRICT_TEXT = sql_strict(sql_decomposed("text"))


@query("v1_strict_form", f"SELECT doc_id, {SQL_STRICT_TEXT} AS strict FROM documents")
def v1(spark, d):
    return documents(spark, d).select("doc_id", tx.strict_form(F.col("text")).alias("strict"))


@query("v2_loose_form", f"WITH t AS (SELECT doc_id, {SQL_STRICT_TEXT} AS strict FROM documents) SELECT doc_id, {sql_loose('strict')} AS loose FROM t")
def v2(spark, d):
    rows = documents(spark, d).select("doc_id", tx.strict_form(F.col("text")).alias("strict"))
    return rows.select("doc_id", tx.loose_form(F.col("strict")).alias("loose"))


SQL_STOPWORDS = ", ".join(f"'{w}'" for w in quotes.STOPWORDS)


def sql_content(loose: str) -> str:
    return f"list_distinct(list_filter(string_split({loose}, ' '), lambda w: length(w) >= 3 AND w NOT IN ({SQL_STOPWORDS})))"


_BARE = sql_strip("regexp_replace(" + sql_strip("raw") + ", '^[“”‘’\"'']+|[“”‘’\"'']+$', '', 'g')")


def sql_segments(form, least: int) -> str:
    return f"list_filter(list_transform(string_split(bare, '...'), lambda p: {form('p')}), lambda p: length(p) >= {least})"


# Normal forms of quotes and documents.
SQL_FORMS = f"""{SQL_QUOTES},
q0 AS (SELECT quote_id, passage, cited, {sql_decomposed('passage')} AS raw FROM quotes),
q1 AS (SELECT *, {_BARE} AS bare, {sql_strict('raw')} AS q_strict FROM q0),
q2 AS (SELECT *, {sql_loose('q_strict')} AS q_loose, {sql_segments(sql_strict, 10)} AS ps, {sql_segments(lambda p: sql_loose(sql_strict(p)), 18)} AS pl,
       {sql_strict("replace(bare, '...', ' ')")} AS whole FROM q1),
q3 AS (SELECT quote_id, passage, cited, q_strict, q_loose, CASE WHEN len(ps) > 0 THEN ps WHEN whole <> '' THEN [whole] ELSE [] END AS s_strict,
       CASE WHEN len(pl) > 0 THEN pl WHEN {sql_loose('whole')} <> '' THEN [{sql_loose('whole')}] ELSE [] END AS s_loose FROM q2),
q AS (SELECT *, {sql_content("CASE WHEN len(s_loose) > 0 THEN array_to_string(s_loose, ' ') ELSE q_loose END")} AS q_words FROM q3),
c0 AS (SELECT doc_id, source, {SQL_STRICT_TEXT} AS c_strict FROM documents),
c1 AS (SELECT *, {sql_loose('c_strict')} AS c_loose FROM c0),
c AS MATERIALIZED (SELECT *, {sql_content('c_loose')} AS c_words FROM c1)"""


@query("v3_ellipsis_segments", f"WITH {SQL_FORMS} SELECT quote_id, array_to_string(s_strict, '|') AS strict, array_to_string(s_loose, '|') AS loose FROM q")
def v3(spark, d):
    q = quotes.prepare_quotes(quote_table(spark, d), "passage")
    return q.select("quote_id", F.array_join("s_strict", "|").alias("strict"), F.array_join("s_loose", "|").alias("loose"))


def sql_in_order(body: str, segs: str) -> str:
    return (
        f"(len({body}) > 0 AND len({segs}) > 0 AND list_reduce(list_prepend({body}, {segs}), "
        "lambda a, x: CASE WHEN strpos(a, x) = 0 THEN NULL ELSE substr(a, strpos(a, x) + length(x)) END) IS NOT NULL)"
    )


SQL_COVER = "CASE WHEN len(q_words) < 6 THEN 0 ELSE len(list_intersect(q_words, c_words)) / len(q_words) END"


def sql_windows(least: int, word_start: bool = False, share: float = 0.0) -> str:
    keep = "s = 1 OR substr(q_strict, s - 1, 1) = ' '" if word_start else "true"
    fits = f"w / length(q_strict) >= {share}" if share else "true"
    return (
        f"flatten([[substr(q_strict, s, w) for s in range(1, length(q_strict) - w + 2, 10) if {keep}] "
        f"for w in range(least(60, length(q_strict)), {least - 1}, -10) if {fits}])"
    )


def sql_any_window(cuts: str) -> str:
    return f"len(list_filter({cuts}, lambda x: contains(c_strict, x))) > 0"


SQL_CITED = f"""{SQL_FORMS},
p AS (SELECT q.*, c.doc_id IS NOT NULL AS cited_found, coalesce(c_strict, '') AS c_strict, coalesce(c_loose, '') AS c_loose, coalesce(c_words, []) AS c_words,
      {sql_windows(30)} AS cuts FROM q LEFT JOIN c ON c.doc_id = q.cited),
t AS (SELECT *, {sql_in_order('c_strict', 's_strict')} AS is_strict, {sql_in_order('c_loose', 's_loose')} AS is_loose,
      c_strict <> '' AND {sql_any_window('cuts')} AS is_window, {SQL_COVER} AS cover FROM p)"""


def prepared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = quotes.prepare_corpus(documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"), "text").drop("text")
    return quotes.prepare_quotes(quote_table(spark, d), "passage"), chunks


def cited_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every quote beside the normal forms of the document it cites. Other documents leave before they are normalised."""
    q, c = prepared(spark, d)
    c = keep_ids(c, "chunk_id", q.select(F.col("cited").alias("chunk_id")))
    pairs = q.join(c.withColumnRenamed("chunk_id", "cited"), "cited", "left")
    return pairs.fillna("", ["c_strict", "c_loose"])


@query("v4_segments_in_order", f"WITH {SQL_CITED} SELECT quote_id, is_strict, is_loose FROM t")
def v4(spark, d):
    return cited_pairs(spark, d).select(
        "quote_id", quotes.in_order(F.col("c_strict"), F.col("s_strict")).alias("is_strict"),
        quotes.in_order(F.col("c_loose"), F.col("s_loose")).alias("is_loose"),
    )


@query("v5_token_coverage", f"WITH {SQL_CITED} SELECT quote_id, round(cover + 1e-9, 6) AS cover FROM t")
def v5(spark, d):
    return cited_pairs(spark, d).select(
        "quote_id", r6(quotes.coverage(F.col("q_words"), quotes.content_words(F.col("c_loose")))).alias("cover")
    )


@query("v6_sliding_window", f"WITH {SQL_CITED} SELECT quote_id, list_filter(cuts, lambda x: contains(c_strict, x))[1] AS hit FROM t")
def v6(spark, d):
    pairs = cited_pairs(spark, d).withColumn("cuts", quotes.windows(F.col("q_strict"), 30))
    return pairs.select("quote_id", quotes.first_window(F.col("cuts"), F.col("c_strict")).alias("hit"))


SQL_VERIFIED = f"""{SQL_CITED},
m1 AS (SELECT quote_id, passage, cited, cited_found, CASE WHEN is_strict THEN 'strict_segments' WHEN is_loose THEN 'loose_segments' WHEN is_window THEN 'sliding_window'
       WHEN cover >= 0.95 THEN 'token_coverage' WHEN cover >= 0.86 THEN 'approximate' END AS method, cover, length({sql_strip('passage')}) < 5 AS brief FROM t),
open AS MATERIALIZED (SELECT q.*, {sql_windows(50, True, 0.5)} AS cuts FROM q JOIN m1 USING (quote_id) WHERE m1.method IS NULL AND NOT m1.brief),
x AS (SELECT quote_id, doc_id, CASE WHEN {sql_in_order('c_strict', 's_strict')} THEN 'strict_segments' WHEN {sql_in_order('c_loose', 's_loose')} THEN 'loose_segments'
      WHEN {sql_any_window('cuts')} THEN 'sliding_window' END AS method, {SQL_COVER} AS cover FROM open, c),
b AS (SELECT quote_id, min(doc_id) FILTER (method IS NOT NULL) AS hit_id, arg_min(method, doc_id) FILTER (method IS NOT NULL) AS hit_method,
      max(cover) AS cover, arg_min(doc_id, (-cover, doc_id)) AS cover_id FROM x GROUP BY quote_id),
verified AS (SELECT m1.quote_id, m1.cited, m1.cited_found, m1.passage,
  CASE WHEN brief THEN 'too_short' WHEN m1.method = 'approximate' THEN 'approximate_quote' WHEN m1.method IS NOT NULL THEN 'verified' WHEN hit_id IS NOT NULL OR b.cover >= 0.95 THEN 'displacement'
       WHEN b.cover >= 0.90 THEN 'approximate_displacement' ELSE 'fabrication' END AS outcome,
  CASE WHEN brief THEN NULL WHEN m1.method = 'approximate' THEN 'token_coverage' WHEN m1.method IS NOT NULL THEN m1.method WHEN hit_id IS NOT NULL THEN hit_method WHEN b.cover >= 0.90 THEN 'token_coverage' END AS method,
  CASE WHEN brief THEN NULL WHEN m1.method IN ('approximate', 'token_coverage') THEN m1.cover WHEN m1.method IS NULL AND hit_id IS NULL AND b.cover >= 0.90 THEN b.cover END AS score,
  CASE WHEN brief THEN NULL WHEN m1.method IS NOT NULL THEN m1.cited WHEN hit_id IS NOT NULL THEN hit_id WHEN b.cover >= 0.90 THEN cover_id END AS match_id
  FROM m1 LEFT JOIN b USING (quote_id))"""


def verified(spark: SparkSession, d: str) -> DataFrame:
    return quotes.verify_quotes(quote_table(spark, d), documents(spark, d), "quote_id", "passage", "cited", "doc_id", "text")


@query("v7_staged_verification", f"WITH {SQL_VERIFIED} SELECT quote_id, cited, cited_found, outcome, method, round(score + 1e-9, 6) AS score, match_id FROM verified")
def v7(spark, d):
    return verified(spark, d).select("quote_id", "cited", "cited_found", "outcome", "method", r6("score").alias("score"), "match_id")


@query("v7_every_sentence", f"WITH {SQL_VERIFIED} SELECT quote_id, cited, cited_found, outcome, method, round(score + 1e-9, 6) AS score, match_id FROM verified")
def v7_every(spark, d):
    """The rows of ``v7_staged_verification``, which also takes all sentences; kept for its name."""
    return v7(spark, d)


SQL_LABEL = r"list_distinct(list_filter(string_split({}, ' '), lambda w: length(w) > 2))"


def _sql_label(e: str) -> str:
    inner = sql_squeeze(f"regexp_replace(regexp_replace({sql_strip(e)}, '(?i)^source:[ ]*', ''), '[.,;:()-]', ' ', 'g')")
    return SQL_LABEL.format(f"lower({inner})")


SQL_AGREE = "(len(a) = 0 OR len(b) = 0 OR len(list_intersect(a, b)) / greatest(len(a), len(b)) >= 0.35)"
CLAIM = "'Source: ' || upper(source) || ', ' || CASE n_chars % 3 WHEN 0 THEN lang || 'x.' WHEN 1 THEN 'third debate, 1858' ELSE '' END"
ACTUAL = "source || ' (' || lang || 'x)'"


@query("v8_source_agreement", f"""
WITH l AS (SELECT doc_id, {_sql_label('(' + ACTUAL + ')')} AS a, {_sql_label('(' + CLAIM + ')')} AS b FROM documents)
SELECT doc_id, {SQL_AGREE} AS agrees FROM l""")
def v8(spark, d):
    return documents(spark, d).select("doc_id", quotes.same_source(F.expr(ACTUAL), F.expr(CLAIM)).alias("agrees"))


# Answers: per labelled quality and document group, a match map naming the quotes.
@query("v9_verify_matches", f"""WITH {SQL_VERIFIED},
m AS (SELECT CAST(cited % 50 AS BIGINT) AS query_id, 'Match ' || quote_id AS match, cited, cited_found, outcome, CASE cited % 5 WHEN 0 THEN 'wrong label' ELSE 'Source: ' || d.source END AS claimed, d.source AS actual
      FROM verified v LEFT JOIN documents d ON d.doc_id = v.cited),
l AS (SELECT *, {_sql_label("coalesce(actual, '')")} AS a, {_sql_label("coalesce(claimed, '')")} AS b FROM m)
SELECT query_id, match, cited, cited_found, CASE WHEN outcome = 'verified' AND coalesce(claimed, '') <> '' AND NOT {SQL_AGREE} THEN 'source_mislabeled' ELSE outcome END AS outcome,
       CASE WHEN cited % 2 = 0 THEN cited / 2 + 1 END::BIGINT AS cited_rank, cited % 2 = 0 AS cited_in_top FROM l""")
def v9(spark, d):
    return match_verification(spark, d).select("query_id", "match", "cited", "cited_found", "outcome", "cited_rank", "cited_in_top")


def match_verification(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", F.col("source").alias("own"))
    named = quote_table(spark, d).join(docs, F.col("cited") == F.col("doc_id"), "left")
    label = F.when(F.col("cited") % 5 == 0, "wrong label").otherwise(F.concat(F.lit("Source: "), F.col("own")))
    cell = F.struct(F.concat(F.lit("Text #: "), F.col("cited")).alias("text_id"), label.alias("source"), F.col("passage").alias("key_quote"))
    # One answer per quote, as a map with one match each, to keep answers of bounded size.
    answers = named.select(
        (F.col("cited") % 50).alias("query_id"), F.create_map(F.concat(F.lit("Match "), F.col("quote_id")), cell).alias("matches")
    )
    ranked = documents(spark, d).filter("doc_id % 2 = 0").select(
        (F.col("doc_id") % 50).alias("query_id"), "doc_id", (F.col("doc_id") / 2 + 1).cast("long").alias("rank")
    )
    return quotes.verify_matches(answers, "query_id", "matches", ranked, documents(spark, d), "doc_id", "source", "text")


@query("v10_outcome_counts", f"""WITH {SQL_VERIFIED}
SELECT CAST(cited % 50 AS BIGINT) AS query_id, {', '.join(f"count(*) FILTER (outcome = '{o}') AS n_{o}" for o in quotes.OUTCOMES)} FROM verified GROUP BY 1""")
def v10(spark, d):
    rows = verified(spark, d).withColumn("query_id", F.col("cited") % 50)
    return quotes.outcome_counts(rows, "query_id")


# Answers quoting a sentence: every sentence of an assistant turn in quote marks of a style set by the turn.
def quoted_answers(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").filter("role = 'assistant'")
    turns = turns.select("conv_id", "turn", F.posexplode(tx.sentences(F.col("text"))).alias("place", "sentence"))
    first = F.regexp_replace("sentence", "[\"'“”‘’\\n]", "")
    style = F.col("turn") % 4
    marks = [F.when(style == k, F.lit(m)) for k, m in enumerate([a for a, _ in quotes.QUOTE_MARKS])]
    ends = [F.when(style == k, F.lit(m)) for k, m in enumerate([b for _, b in quotes.QUOTE_MARKS])]
    return turns.withColumn("first", first).select(
        "conv_id", "turn", (F.col("place") + 1).cast("long").alias("place"), "first",
        F.concat(F.lit("He doesn't say "), F.coalesce(*marks), "first", F.coalesce(*ends), F.lit(" at once.")).alias("answer"),
    )


SQL_QUOTED = f"""
s AS (SELECT conv_id, turn, {sql_sentences('text')} AS ss FROM conversations WHERE role = 'assistant'),
p AS (SELECT conv_id, turn, ss, unnest(range(1, len(ss) + 1)) AS place FROM s),
f AS (SELECT conv_id, turn, place, regexp_replace(ss[place], '["''“”‘’\\n]', '', 'g') AS first FROM p),
g AS (SELECT *, 'He doesn''t say ' || (CASE turn % 4 WHEN 0 THEN '“' WHEN 1 THEN '"' WHEN 2 THEN '‘' ELSE '''' END) AS head,
      (CASE turn % 4 WHEN 0 THEN '”' WHEN 1 THEN '"' WHEN 2 THEN '’' ELSE '''' END) AS tail FROM f WHERE first IS NOT NULL)"""


@query("v11_inline_quotes", f"""WITH {SQL_QUOTED}
SELECT conv_id, turn, place, turn % 4 AS style, first AS span FROM g WHERE length(first) >= 15""")
def v11(spark, d):
    rows = quoted_answers(spark, d)
    return rows.select("conv_id", "turn", "place", F.explode(quotes.inline_quotes(F.col("answer"))).alias("q")).select(
        "conv_id", "turn", "place", F.col("q.style").cast("long").alias("style"), F.col("q.span").alias("span")
    )


@query("v11_answer_marking", f"""WITH {SQL_QUOTED}
SELECT conv_id, turn, place, head || first || tail || CASE WHEN length(rtrim(first, '.,;:!? ')) >= 15 OR turn % 8 < 4 THEN ' [ok]' ELSE '' END || ' at once.' AS marked FROM g""")
def v11_marking(spark, d):
    longer = F.concat(F.lit("In short: "), F.col("first"))
    passage = F.when(F.col("turn") % 8 < 4, F.col("first")).otherwise(longer)
    return quoted_answers(spark, d).select("conv_id", "turn", "place", quotes.mark_answer(F.col("answer"), passage, F.lit("[ok]")).alias("marked"))


@query("v12_cited_ids", """
SELECT conv_id, string_agg(c, ',' ORDER BY first) AS cited FROM
(SELECT conv_id, length(text) % 40 AS c, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id""")
def v12(spark, d):
    rows = conversation_matches(spark, d).select("conv_id", F.array_join(quotes.cited_ids(F.col("matches")).cast("array<string>"), ",").alias("cited"))
    return rows


@query("v12_missing_citations", """
SELECT DISTINCT conv_id, CAST(length(text) * 37 AS BIGINT) AS cited FROM conversations WHERE length(text) * 37 NOT IN (SELECT doc_id FROM documents)""")
def v12_missing(spark, d):
    asked = conversation_matches(spark, d, F.length("text") * 37)
    return quotes.missing_citations(asked, "conv_id", "matches", documents(spark, d), "doc_id")


def conversation_matches(spark: SparkSession, d: str, number: Column | None = None) -> DataFrame:
    """A match map per conversation: one entry per turn (2-8 turns each), citing the text ``number``."""
    n = F.length("text") % 40 if number is None else number
    entry = F.struct(
        "turn", F.concat(F.lit("Match "), F.col("turn")).alias("name"),
        F.struct(F.concat(F.lit("Text #: "), n).alias("text_id"), F.lit("").alias("source"), F.col("text").alias("key_quote")).alias("m"),
    )
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return per.select("conv_id", F.map_from_entries(F.transform("e", lambda x: F.struct(x["name"], x["m"]))).alias("matches"))
