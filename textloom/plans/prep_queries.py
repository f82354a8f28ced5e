"""Registered queries: corpus preparation and statistics."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import text as tx
from textloom.operators import containment, prep, termstats
from textloom.plans.registry import (
    query, r6, sql_runs, sql_sentences, sql_squeeze, sql_strip, sql_words, table,
)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# ---- ids, lookups, bodies ------------------------------------------------------------------

MIXED_ID = "CASE lang WHEN 'en' THEN 'Text #: ' || doc_id WHEN 'fr' THEN '  ' || doc_id || ' ' WHEN 'de' THEN 'doc 00' || doc_id ELSE 'none' END"


@query("p1_id_normalisation", f"""
WITH t AS (SELECT doc_id, {MIXED_ID} AS raw FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(raw, '[0-9]') THEN 'Text #: ' || CAST(regexp_extract(raw, '([0-9]+)', 1) AS BIGINT)
                    ELSE trim(raw) END AS text_id,
       TRY_CAST(regexp_extract(raw, '([0-9]+)', 1) AS BIGINT) AS number,
       coalesce(TRY_CAST(regexp_extract(raw, '([0-9]+)', 1) AS BIGINT), -1) AS number_or_minus,
       trim(replace(trim(raw), 'Text #: ', '')) AS bare
FROM t""")
def p1(spark, d):
    raw = F.expr(MIXED_ID)
    return documents(spark, d).select(
        "doc_id", tx.id_label(raw).alias("text_id"), tx.id_number(raw).alias("number"),
        F.coalesce(tx.id_number(raw), F.lit(-1)).alias("number_or_minus"), tx.id_bare(raw).alias("bare"),
    )


@query("p2_multi_key_lookup", """
SELECT l.doc_id, l.quality, d.source, d.n_chars FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def p2(spark, d):
    written = F.expr("CASE quality WHEN 1 THEN 'Text #: ' || doc_id ELSE ' ' || doc_id END")
    rows = table(spark, d, "labels").select("doc_id", "quality", written.alias("cited"))
    corpus = documents(spark, d).select(F.col("doc_id").alias("chunk"), "source", "n_chars")
    return prep.lookup(rows, "cited", corpus, "chunk").select("doc_id", "quality", "source", "n_chars")


COMBINED = "'Text #: ' || doc_id || chr(10) || 'Full Text:' || chr(10) || replace(text, 'Full Text:', '') || chr(10) || ' Summary: in ' || lang"


@query("p3_body_extraction", f"""
WITH c AS (SELECT doc_id, {COMBINED} AS combined FROM documents)
SELECT doc_id,
       {sql_strip("split_part(substr(combined, strpos(combined, 'Full Text:') + 10), chr(10) || ' Summary:', 1)")} AS between_marks,
       {sql_strip("substr(combined, strpos(combined, 'Full Text:') + 10)")} AS after_mark
FROM c""")
def p3(spark, d):
    c = F.expr(COMBINED.replace("chr(10)", "'\\n'"))
    return documents(spark, d).select(
        "doc_id", tx.body_between(c).alias("between_marks"), tx.body_after(c).alias("after_mark")
    )


@query("p4_vector_parsing", """
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dimension, round(list_sum([CAST(x AS DOUBLE) for x in embedding]), 4) AS total
FROM embeddings""")
def p4(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.to_json("embedding").alias("raw"))
    vec = tx.parse_vector(F.col("raw"))
    total = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.size(vec).cast("long").alias("dimension"), F.round(total, 4).alias("total"))


@query("p5_exclusion_and_empty_drop", f"""
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'excluded' WHEN coalesce({sql_strip('d.text')}, '') = '' THEN 'empty' ELSE 'kept' END AS status
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)""")
def p5(spark, d):
    out = table(spark, d, "labels").filter("toxic = 1")
    kept, rejected = prep.usable_texts(documents(spark, d), "doc_id", "text", out)
    return kept.select("doc_id", F.lit("kept").alias("status")).unionByName(
        rejected.select("doc_id", F.col("reason").alias("status"))
    )


@query("p6_label_override", """
SELECT d.doc_id, coalesce('reviewed ' || d.source, d.source) AS source FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1
UNION ALL
SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def p6(spark, d):
    docs = documents(spark, d)
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    fixes = docs.join(good, "doc_id").select("doc_id", F.concat(F.lit("reviewed "), F.col("source")).alias("fixed_source"))
    return prep.override_labels(docs, "doc_id", "source", fixes).select("doc_id", "source")


RAW_TEXT = "'Mr. Clay''s Speech.' || chr(13) || chr(10) || text || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || '[Cheers.]  [A VOICE: yes]' || '\\n\\n' || 'end  of ' || source"


@query("p7_text_cleaning", f"""
WITH r AS (SELECT doc_id, {RAW_TEXT} AS raw FROM documents),
a AS (SELECT doc_id, raw, regexp_replace(replace(replace(replace(raw, '\\n\\n', chr(10) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)),
                          '(?i)Mr\\.?[ \\t\\n\\f\\r]+Clay''?s?[ \\t\\n\\f\\r]+(Speech|Reply)\\.?', '', 'g') AS b FROM r)
SELECT doc_id, {sql_strip("regexp_replace(regexp_replace(b, ' {2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS cleaned,
       CAST(len(regexp_extract_all(raw, '\\[[^\\n]*?\\]')) AS BIGINT) AS n_interjections
FROM a""")
def p7(spark, d):
    raw = F.concat(
        F.lit("Mr. Clay's Speech.\r\n"), F.col("text"), F.lit("\r\n\n\n\n[Cheers.]  [A VOICE: yes]\\n\\nend  of "), F.col("source")
    )
    return documents(spark, d).select(
        "doc_id", tx.clean_text(raw, "Clay").alias("cleaned"), tx.interjections(raw).alias("n_interjections")
    )


SQL_PARAGRAPHS = f"list_filter(list_transform(string_split(text, chr(10)), lambda p: {sql_strip('p')}), lambda p: p <> '')"


@query("p8_paragraph_split", f"""
SELECT doc_id, CAST(unnest(range(len(ps))) AS BIGINT) AS position, unnest(ps) AS paragraph
FROM (SELECT doc_id, {SQL_PARAGRAPHS} AS ps FROM documents)""")
def p8(spark, d):
    rows = documents(spark, d).select("doc_id", F.posexplode(tx.paragraphs(F.col("text"), "\n")).alias("position", "paragraph"))
    return rows.withColumn("position", F.col("position").cast("long"))


@query("p9_sentence_split", f"""
SELECT doc_id, CAST(unnest(range(len(ss))) AS BIGINT) AS position, unnest(ss) AS sentence
FROM (SELECT doc_id, {sql_sentences('text')} AS ss FROM documents)""")
def p9(spark, d):
    rows = documents(spark, d).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("position", "sentence"))
    return rows.withColumn("position", F.col("position").cast("long"))


# The state of the packing is one string: sealed pieces and the open one, separated by chr(2).
SQL_CHUNKS = f"""
paras AS (SELECT doc_id, source, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (SELECT doc_id, source, {SQL_PARAGRAPHS} AS ps FROM documents)),
cut AS (SELECT doc_id, source, i, CASE WHEN length(p) > 900 THEN {sql_sentences('p')} ELSE [p] END AS ss FROM paras),
parts AS (SELECT doc_id, source, i, unnest(range(len(ss))) AS j, unnest(ss) AS part FROM cut),
lists AS (SELECT doc_id, source, list(part ORDER BY i, j) AS ps FROM parts GROUP BY doc_id, source),
packed AS (SELECT doc_id, source, list_filter(string_split(list_reduce(list_prepend('', ps), lambda a, x:
    CASE WHEN length(string_split(a, chr(2))[-1]) = 0 THEN a || x
         WHEN length(string_split(a, chr(2))[-1]) + length(x) + 2 <= 900 THEN a || chr(10) || chr(10) || x
         WHEN length(string_split(a, chr(2))[-1]) >= 700 THEN a || chr(2) || x
         ELSE a || chr(10) || chr(10) || x || chr(2) END), chr(2)), lambda c: c <> '') AS cs FROM lists),
chunks AS (SELECT doc_id, source, CAST(len(cs) AS BIGINT) AS total_in_source, CAST(unnest(range(len(cs))) AS BIGINT) AS position,
                  unnest(cs) AS full_text FROM packed)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return prep.build_chunks(documents(spark, d), "doc_id", "source", "text", separator="\n")


@query("p10_greedy_chunk_packing", f"WITH {SQL_CHUNKS} SELECT doc_id, position, full_text FROM chunks")
def p10(spark, d):
    rows = documents(spark, d).select("doc_id", F.posexplode(tx.chunk_text(F.col("text"), "\n")).alias("position", "full_text"))
    return rows.withColumn("position", F.col("position").cast("long"))


@query("p11_chunk_numbering", f"""WITH {SQL_CHUNKS}
SELECT doc_id, position, total_in_source, row_number() OVER (ORDER BY doc_id, position) - 1 AS chunk_id,
       'Text #: ' || (row_number() OVER (ORDER BY doc_id, position) - 1) AS text_id,
       'From the ' || source || ', passage ' || (position + 1) || ' of ' || total_in_source || '.' AS chunk_context
FROM chunks""")
def p11(spark, d):
    return chunks(spark, d).select("doc_id", "position", "total_in_source", "chunk_id", "text_id", "chunk_context")


@query("p12_word_segments", f"""
WITH w AS (SELECT doc_id, {sql_words('text')} AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(0, len(ws), 50)) AS first FROM w)
SELECT doc_id, CAST(first / 50 AS BIGINT) AS position, array_to_string(ws[first + 1 : first + 100], ' ') AS segment FROM s""")
def p12(spark, d):
    rows = documents(spark, d).select("doc_id", F.posexplode(tx.word_segments(F.col("text"))).alias("position", "segment"))
    return rows.withColumn("position", F.col("position").cast("long"))


@query("p13_combined_field", """
WITH c AS (SELECT doc_id, 'Text #: ' || doc_id || chr(10) || chr(10) || 'Source: ' || source || chr(10) || chr(10) || 'From ' || source || '.' || chr(10) || chr(10) || text
       || CASE WHEN lang = 'en' THEN chr(10) || chr(10) || 'Summary: in ' || lang ELSE '' END
       || chr(10) || chr(10) || 'Keywords: ' || lang || ', ' || source
       || CASE WHEN lang = 'fr' THEN '' ELSE chr(10) || chr(10) || 'Concepts: ' || source END AS combined FROM documents)
SELECT doc_id, combined, length(combined) > 30000 AS too_long FROM c""")
def p13(spark, d):
    combined = tx.combined_field(
        F.concat(F.lit("Text #: "), F.col("doc_id")), F.col("source"), F.concat(F.lit("From "), F.col("source"), F.lit(".")),
        F.col("text"), F.when(F.col("lang") == "en", F.concat(F.lit("in "), F.col("lang"))).otherwise(""),
        F.array("lang", "source"), F.when(F.col("lang") == "fr", F.lit(None)).otherwise(F.col("source")),
    )
    return documents(spark, d).select("doc_id", combined.alias("combined")).withColumn("too_long", F.length("combined") > 30000)


@query("p14_keyword_list", f"""
SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, ','), lambda k: {sql_strip('k')}), lambda k: k <> ''), '|') AS keywords
FROM conversations""")
def p14(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.array_join(tx.keyword_list(F.col("text")), "|").alias("keywords")
    )


@query("p15_source_key", rf"""
SELECT doc_id, {sql_squeeze("regexp_replace(regexp_replace(lower('Source:  ' || lang || '/' || source || ', No. ' || n_chars || '!'), '^source:[ ]*', ''), '[^0-9a-z]', ' ', 'g')")} AS source_key
FROM documents""")
def p15(spark, d):
    label = F.concat(F.lit(" Source:  "), F.col("lang"), F.lit("/"), F.col("source"), F.lit(", No. "), F.col("n_chars"), F.lit("!"))
    return documents(spark, d).select("doc_id", tx.source_key(label).alias("source_key"))


@query("p16_tagged_lines", f"""
SELECT doc_id, {sql_strip("replace(text, chr(10), ' ')")} AS summary, lang || '|' || source AS keywords, 'size ' || n_chars AS concepts FROM documents""")
def p16(spark, d):
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    reply = F.concat(
        F.lit("SUMMARY: "), line, F.lit("\nKEYWORDS: "), F.col("lang"), F.lit(" ,"), F.col("source"), F.lit(",\nKEYWORDS_SEMANTIC: size "), F.col("n_chars")
    )
    return documents(spark, d).select(
        "doc_id", tx.tagged_line(reply, "SUMMARY").alias("summary"),
        F.array_join(tx.keyword_list(tx.tagged_line(reply, "KEYWORDS")), "|").alias("keywords"),
        tx.tagged_line(reply, "KEYWORDS_SEMANTIC").alias("concepts"),
    )


@query("p17_neighbour_context", """
SELECT conv_id, turn, string_agg(nullif(text, ''), chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context
FROM conversations""")
def p17(spark, d):
    rows = table(spark, d, "conversations")
    return prep.neighbour_context(rows, "conv_id", "turn", "text").select("conv_id", "turn", "context")


@query("p18_metadata_enrichment", """
SELECT l.doc_id + 500 AS doc_id, l.quality, coalesce(d.source, '') AS source, coalesce(d.lang, '') AS lang, coalesce(d.text, '') AS text
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id + 500""")
def p18(spark, d):
    hits = table(spark, d, "labels").select((F.col("doc_id") + 500).alias("doc_id"), "quality")
    return prep.enrich(hits, documents(spark, d), "doc_id", ["source", "lang", "text"])


SECOND = f"({sql_sentences('text')})[2]"


@query("p19_quote_highlighting", rf"""
WITH q AS (SELECT doc_id, text, {SECOND} AS quote, {sql_words(SECOND)} AS ws FROM documents),
p AS (SELECT doc_id, text, quote, len(ws) >= 6 AS split, rtrim(array_to_string(ws[1:2], ' '), '.') AS a, array_to_string(ws[-2:], ' ') AS b FROM q WHERE quote IS NOT NULL)
SELECT doc_id, regexp_replace(text, CASE WHEN split THEN '(?i)' || regexp_escape(a) || '\s*.*?\s*' || regexp_escape(b) || '[.;,]?'
                                    ELSE '(?i)' || regexp_escape(quote) || '\s*[.;,]?' END, '<mark>\0</mark>', 'g') AS marked
FROM p""")
def p19(spark, d):
    quote = F.try_element_at(tx.sentences(F.col("text")), F.lit(2))
    ws = tx.split_words(quote)
    short = F.when(
        F.size(ws) >= 6,
        F.concat(F.rtrim(F.array_join(F.slice(ws, 1, 2), " "), F.lit(".")), F.lit("..."), F.array_join(F.slice(ws, -2, 2), " ")),
    ).otherwise(quote)
    rows = documents(spark, d).select("doc_id", "text", short.alias("quote")).filter("quote is not null")
    return rows.select("doc_id", tx.highlight(F.col("text"), F.col("quote")).alias("marked"))


SQL_SIGNATURE = f"left(sha1(text), 10) AS sha1_10, CAST(length(text) AS BIGINT) AS len, CASE WHEN length({sql_squeeze('text')}) > 160 THEN left({sql_squeeze('text')}, 160) || '…' ELSE {sql_squeeze('text')} END AS preview"


@query("p20_content_signature", f"SELECT doc_id, source, {SQL_SIGNATURE} FROM documents")
def p20(spark, d):
    return prep.signatures(documents(spark, d), "doc_id", "source", "text")


@query("p20_index_drift", f"""
WITH a AS (SELECT doc_id, left(sha1(text), 10) AS left_sha, CAST(length(text) AS BIGINT) AS left_len FROM documents WHERE lang <> 'es'),
b AS (SELECT doc_id, left(sha1({sql_squeeze('text')}), 10) AS right_sha, CAST(length({sql_squeeze('text')}) AS BIGINT) AS right_len FROM documents WHERE lang <> 'de')
SELECT doc_id, left_sha, left_len, right_sha, right_len,
       CASE WHEN left_sha IS NULL THEN 'only_right' WHEN right_sha IS NULL THEN 'only_left' ELSE 'changed' END AS status
FROM a FULL JOIN b USING (doc_id) WHERE left_sha IS DISTINCT FROM right_sha""")
def p20_drift(spark, d):
    docs = documents(spark, d)
    left = prep.signatures(docs.filter("lang <> 'es'"), "doc_id", "source", "text")
    squeezed = docs.filter("lang <> 'de'").withColumn("text", tx.squeeze(F.col("text")))
    return prep.index_drift(left, prep.signatures(squeezed, "doc_id", "source", "text"), "doc_id")


@query("p21_quote_location", f"""
WITH q AS (SELECT doc_id, text, rtrim(coalesce({sql_sentences('text')}[1], ''), '.') AS a, coalesce({sql_sentences('text')}[3], '') AS b FROM documents)
SELECT doc_id, CASE WHEN b = '' THEN a WHEN contains(text, a || '...' || b) THEN a || '...' || b WHEN length(a) > 20 THEN a WHEN length(b) > 20 THEN b END AS found FROM q""")
def p21(spark, d):
    s = tx.sentences(F.col("text"))
    first, third = F.rtrim(F.coalesce(F.try_element_at(s, F.lit(1)), F.lit("")), F.lit(".")), F.coalesce(F.try_element_at(s, F.lit(3)), F.lit(""))
    quote = F.when(third == "", first).otherwise(F.concat(first, F.lit("..."), third))
    return documents(spark, d).select("doc_id", tx.locate_quote(F.col("text"), quote).alias("found"))


@query("p22_index_eligibility", """
SELECT doc_id, 'doc_' || (row_number() OVER (ORDER BY doc_id) - 1) AS index_id, length(text) >= 10 AS kept FROM documents""")
def p22(spark, d):
    kept, rejected = prep.loadable(documents(spark, d), "doc_id", "text")
    return kept.select("doc_id", "index_id", F.lit(True).alias("kept")).unionByName(
        rejected.select("doc_id", "index_id", F.lit(False).alias("kept"))
    )


# ---- corpus statistics -----------------------------------------------------------------------

SQL_TERMS = f"""
toks AS (SELECT doc_id, unnest({sql_runs('text')}) AS term FROM documents),
terms AS (SELECT term, count(*) AS raw_freq, count(DISTINCT doc_id) AS doc_freq FROM toks GROUP BY term)"""


def terms(spark: SparkSession, d: str) -> DataFrame:
    return termstats.term_table(documents(spark, d), F.col("text"))


@query("t1_term_frequency", f"WITH {SQL_TERMS} SELECT term, raw_freq, doc_freq FROM terms")
def t1(spark, d):
    return terms(spark, d)


@query("t2_relative_frequency", f"""WITH {SQL_TERMS}
SELECT term, round(raw_freq / (SELECT sum(raw_freq) FROM terms), 9) AS rel_freq FROM terms""")
def t2(spark, d):
    return termstats.relative_frequency(terms(spark, d)).select("term", F.round("rel_freq", 9).alias("rel_freq"))


SQL_NOISE = ", ".join(f"'{w}'" for w in termstats.NOISE_WORDS)
SQL_CONTENT = f"lower(term) NOT IN ({SQL_NOISE}) AND NOT regexp_full_match(term, '[0-9,.\\-/%]+') AND length(term) > 3"


@query("t3_content_words", f"WITH {SQL_TERMS} SELECT term, raw_freq, doc_freq FROM terms WHERE {SQL_CONTENT}")
def t3(spark, d):
    return termstats.content_words(terms(spark, d))


SQL_BAND = "CASE WHEN raw_freq BETWEEN 5 AND 75 AND doc_freq >= 2 THEN 'rare' WHEN raw_freq BETWEEN 1 AND 4 THEN 'very_rare' END"


@query("t4_rarity_bands", f"""WITH {SQL_TERMS}
SELECT term, {SQL_BAND} AS band,
       CASE WHEN raw_freq <= 14 AND length(term) * 2 >= 15 THEN 'STRONG' WHEN raw_freq <= 50 AND length(term) * 2 >= 8 THEN 'OK'
            WHEN raw_freq > 50 AND length(term) * 2 >= 15 THEN 'WEAK' ELSE 'OK' END AS keyword_class
FROM terms WHERE {SQL_CONTENT}""")
def t4(spark, d):
    t = termstats.content_words(terms(spark, d))
    return t.select(
        "term", termstats.rarity_band(F.col("raw_freq"), F.col("doc_freq")).alias("band"),
        termstats.keyword_class(F.col("raw_freq"), F.length("term") * 2).alias("keyword_class"),
    )


@query("t5_rare_term_hints", f"""WITH {SQL_TERMS},
bands AS (SELECT term, {SQL_BAND} AS band FROM terms WHERE {SQL_CONTENT}),
hits AS (SELECT DISTINCT doc_id, term, band FROM toks JOIN bands USING (term) WHERE band IS NOT NULL AND regexp_full_match(term, '[a-z]{{4,}}')),
ranked AS (SELECT doc_id, term, band, row_number() OVER (PARTITION BY doc_id ORDER BY band, term) AS r FROM hits)
SELECT d.doc_id, coalesce(string_agg(r.term, ', ' ORDER BY r.band, r.term), 'none identified') AS hint
FROM documents d LEFT JOIN (SELECT * FROM ranked WHERE r <= 20) r ON r.doc_id = d.doc_id GROUP BY d.doc_id""")
def t5(spark, d):
    return termstats.rare_hints(documents(spark, d), "doc_id", F.col("text"), terms(spark, d))


@query("t6_size_histogram", f"""WITH {SQL_CHUNKS},
b AS (SELECT CASE WHEN length(full_text) < 200 THEN 0 WHEN length(full_text) < 400 THEN 200 WHEN length(full_text) < 600 THEN 400
   WHEN length(full_text) < 800 THEN 600 WHEN length(full_text) < 1000 THEN 800 WHEN length(full_text) < 1500 THEN 1000 ELSE 1500 END AS bucket FROM chunks)
SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER () + 1e-9, 6) AS pct FROM b GROUP BY bucket""")
def t6(spark, d):
    rows = documents(spark, d).select(F.explode(tx.chunk_text(F.col("text"), "\n")).alias("full_text"))
    return termstats.size_histogram(rows, F.col("full_text")).withColumn("pct", r6("pct"))


@query("t7_size_statistics", f"""WITH {SQL_CHUNKS}
SELECT count(*) AS n, round(avg(length(full_text)) + 1e-9, 6) AS mean_size, CAST(min(length(full_text)) AS BIGINT) AS min_size,
       CAST(max(length(full_text)) AS BIGINT) AS max_size, count(*) FILTER (length(full_text) > 1500) AS n_over FROM chunks""")
def t7(spark, d):
    rows = documents(spark, d).select(F.explode(tx.chunk_text(F.col("text"), "\n")).alias("full_text"))
    return termstats.size_stats(rows, F.col("full_text")).withColumn("mean_size", r6("mean_size"))


@query("t8_word_reconciliation", f"""WITH {SQL_CHUNKS},
e AS (SELECT source, CAST(sum(len({sql_words('text')})) AS BIGINT) AS expected FROM documents GROUP BY source),
a AS (SELECT source, CAST(sum(len({sql_words('full_text')})) AS BIGINT) AS actual, count(*) AS n_chunks FROM chunks GROUP BY source)
SELECT source, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(n_chunks, 0) AS n_chunks,
       coalesce(expected, 0) - coalesce(actual, 0) AS diff, abs(coalesce(expected, 0) - coalesce(actual, 0)) <= 5 AS ok
FROM e FULL JOIN a USING (source)""")
def t8(spark, d):
    docs = documents(spark, d)
    packed = docs.select("source", F.explode(tx.chunk_text(F.col("text"), "\n")).alias("full_text"))
    return termstats.reconcile_words(docs, packed, "source", F.col("text"), F.col("full_text"))


@query("t9_structural_checks", f"""
SELECT 'sequential_ids' AS "check", greatest(max(doc_id) + 1, count(*)) - count(DISTINCT doc_id) AS failing,
  greatest(max(doc_id) + 1, count(*)) = count(DISTINCT doc_id) AS passed FROM documents
UNION ALL SELECT 'empty_text', count(*) FILTER ({sql_strip("coalesce(text, '')")} = ''), count(*) FILTER ({sql_strip("coalesce(text, '')")} = '') = 0 FROM documents
UNION ALL SELECT 'export_count', n, n = 0 FROM (SELECT abs((SELECT count(*) FROM documents) - (SELECT count(*) FROM labels)) AS n)""")
def t9(spark, d):
    """Documents, against the labels as an export that lacks some."""
    return termstats.structural_checks(documents(spark, d), "doc_id", F.col("text"), exported=table(spark, d, "labels"))


@query("t9_vector_length", """
SELECT 'sequential_ids' AS "check", greatest(max(vec_id) + 1, count(*)) - count(DISTINCT vec_id) AS failing, greatest(max(vec_id) + 1, count(*)) = count(DISTINCT vec_id) AS passed FROM embeddings
UNION ALL SELECT 'empty_text', count(*) FILTER (embedding IS NULL), count(*) FILTER (embedding IS NULL) = 0 FROM embeddings
UNION ALL SELECT 'vector_length', count(*) FILTER (len(embedding) <> 64), count(*) FILTER (len(embedding) <> 64) = 0 FROM embeddings""")
def t9_vectors(spark, d):
    rows = table(spark, d, "embeddings")
    return termstats.structural_checks(rows, "vec_id", F.to_json("embedding"), "embedding", 64)


@query("t9_source_types", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def t9_types(spark, d):
    return termstats.source_type_counts(documents(spark, d), "lang")


@query("t10_phrase_hits", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))")
def t10(spark, d):
    phrases = table(spark, d, "benchmark").withColumn("phrase", F.upper("text"))
    return containment.phrase_hits(phrases, "item_id", "phrase", documents(spark, d), "doc_id", "text")


@query("t10_phrase_report", """
WITH h AS (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS r
           FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)))
SELECT b.item_id, count(h.doc_id) AS n_chunks, string_agg(CASE WHEN r <= 3 THEN doc_id END, ',' ORDER BY doc_id) AS first_chunks, count(h.doc_id) > 0 AS found
FROM benchmark b LEFT JOIN h USING (item_id) GROUP BY b.item_id""")
def t10_report(spark, d):
    phrases = table(spark, d, "benchmark")
    hits = containment.phrase_hits(phrases, "item_id", "text", documents(spark, d), "doc_id", "text")
    return termstats.phrase_report(phrases, hits, "item_id", "doc_id").withColumn("first_chunks", F.array_join("first_chunks", ","))


@query("t10_term_hits", f"""
WITH w AS (SELECT DISTINCT unnest({sql_runs('text')}) AS term FROM benchmark),
toks AS (SELECT DISTINCT doc_id, unnest({sql_runs('text')}) AS term FROM documents)
SELECT term, doc_id FROM w JOIN toks USING (term)""")
def t10_terms(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(tx.word_runs(F.col("text"))).alias("term")).distinct()
    keyed = words.withColumn("t", F.translate("term", ascii_lowercase, ascii_uppercase))
    return containment.term_hits(keyed, "term", "t", documents(spark, d), "doc_id", "text")
