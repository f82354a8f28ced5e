"""Joining hits of several searches into one ranked list, and preparing it for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import text as tx
from textloom.operators.skew import broadcast_if_small, keep_ids, top_n

# Order in which the searches are concatenated.
SEARCH_ORDER = ["Keyword", "Semantic", "ColBERT"]


def union_hits(*hits: DataFrame) -> DataFrame:
    """Concatenate hit tables; columns one of them lacks become null."""
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h, allowMissingColumns=True)
    return out


def _search_order() -> Column:
    order = F.lit(len(SEARCH_ORDER))
    for i, name in reversed(list(enumerate(SEARCH_ORDER))):
        order = F.when(F.col("search_type") == name, F.lit(i)).otherwise(order)
    return order


def dedupe_hits(hits: DataFrame, policy: str = "first") -> DataFrame:
    """One hit per query and text.

    ``first``: in search order, then rank; ``score``: highest score; ``quoted``: the first that
    has a key quote, else the first.
    """
    by_place = [_search_order(), F.col("rank")]
    orders = {
        "first": by_place,
        "score": [F.col("score").desc_nulls_last(), *by_place],
        "quoted": [F.col("key_quote").isNull(), *by_place],
    }
    return top_n(hits, ["query_id", "text_id"], orders[policy], 1, "_keep").drop("_keep")


def provenance(search_type: Column, key_quote: Column) -> Column:
    """Given search type, else Keyword for hits with a key quote and Semantic for others."""
    s = tx.strip(F.coalesce(search_type, F.lit("")))
    return F.when((s == "") | (F.lower(s) == "unknown"), F.when(key_quote.isNotNull(), "Keyword").otherwise("Semantic")).otherwise(s)


def candidate_documents(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Documents for a rerank model: full text and source from the corpus, else from the hit.

    ``hits``: query_id, text_id, search_type, source, summary, key_quote, top_segment;
    ``corpus``: text_id, source, full_text.
    """
    known = corpus.select(
        tx.id_label(F.col("text_id")).alias("_id"), F.col("source").alias("_source"), F.col("full_text").alias("_text")
    )
    kind = provenance(F.col("search_type"), F.col("key_quote"))
    rows = hits.withColumn("search_type", kind).withColumn("_id", F.coalesce(tx.id_label(F.col("text_id")), F.lit("")))
    own = F.when(F.col("search_type") == "Keyword", F.col("key_quote")).otherwise(F.col("top_segment"))
    joined = rows.join(keep_ids(known, "_id", rows), "_id", "left")
    doc = {
        "search_type": F.col("search_type"),
        "text_id": tx.strip(F.coalesce("text_id", F.lit(""))),
        "source": F.coalesce(
            F.nullif(F.col("_source"), F.lit("")), F.nullif(tx.strip(F.coalesce("source", F.lit(""))), F.lit("")),
            F.lit("[Source unknown]"),
        ),
        "summary": tx.strip(F.coalesce("summary", F.lit(""))),
        "full_text": F.coalesce(F.nullif(F.col("_text"), F.lit("")), tx.strip(F.coalesce(own, F.lit("")))),
    }
    fields = [c.alias(k) for k, c in doc.items()]
    return joined.select("query_id", *fields).withColumn("document", F.to_json(F.struct(*doc)))


def rerank(documents: DataFrame, scores: DataFrame, n: int = 15) -> DataFrame:
    """Rank by an external relevance score given as a table ``query_id, text_id, relevance``."""
    scored = documents.join(scores, ["query_id", "text_id"])
    return top_n(scored, ["query_id"], [F.col("relevance").desc(), F.col("text_id")], n)


def formatted_context(ranked: DataFrame, corpus: DataFrame | None = None, n: int = 5) -> DataFrame:
    """One text per query with its first ``n`` matches.

    ``ranked``: query_id, rank, search_type, text_id, source, summary, full_text, relevance.
    """
    rows = ranked.filter(F.col("rank") <= n)
    if corpus is not None:
        known = corpus.select(
            tx.id_label(F.col("text_id")).alias("_id"), F.col("source").alias("_source"), F.col("full_text").alias("_text")
        )
        rows = rows.withColumn("_id", tx.id_label(F.col("text_id")))
        rows = rows.join(keep_ids(known, "_id", rows), "_id", "left")
        rows = rows.withColumn("full_text", F.coalesce(F.nullif(F.col("_text"), F.lit("")), "full_text")).withColumn(
            "source", F.coalesce(F.nullif(tx.strip(F.col("source")), F.lit("")), tx.strip(F.col("_source")))
        )
    source = F.coalesce(F.nullif(tx.strip(F.col("source")), F.lit("")), F.lit("[Source unknown]"))
    entry = F.format_string(
        "Match %d: Search Type - %s, Text ID - %s, Source - %s, "
        "Summary (curatorial description only — not quotable corpus text) - %s, "
        "Full Text (select the most relevant passage to quote directly) - %s, Relevance Score - %.2f",
        F.col("rank"), F.coalesce("search_type", F.lit("Unknown")), F.coalesce("text_id", F.lit("Unknown")), source,
        F.coalesce("summary", F.lit("No summary")), F.coalesce("full_text", F.lit("No quote")),
        F.coalesce("relevance", F.lit(0.0)),
    )
    # At most n entries per query, because of the filter on rank.
    lines = rows.select("query_id", "rank", entry.alias("e")).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "e"))).alias("m")
    )
    return lines.select("query_id", F.array_join(F.transform("m", lambda x: x["e"]), "\n\n").alias("context"))


def contexts_for(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    return queries.select("query_id").join(contexts, "query_id", "left").withColumn(
        "context", F.coalesce("context", F.lit("No results to format"))
    )


def remap_ids(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Resolve hits whose id the corpus lacks to the first chunk with the same source.

    ``hits``: text_id, source, ...; ``corpus``: chunk_id, source. Keeps the reason.
    """
    known = corpus.select(F.col("chunk_id").alias("parsed_id"), F.lit(True).alias("_known"))
    by_source = (
        corpus.select(tx.strip(F.col("source")).alias("_source"), "chunk_id").filter("_source <> ''")
        .groupBy("_source").agg(F.min("chunk_id").alias("_first"))
    )
    by_source = broadcast_if_small(by_source)  # a few labels, each with many rows
    rows = (
        hits.withColumn("parsed_id", tx.id_number(F.col("text_id")))
        .withColumn("_source", tx.strip(F.coalesce("source", F.lit(""))))
        .join(known, "parsed_id", "left").join(by_source, "_source", "left")
    )
    lost = F.col("parsed_id").isNotNull() & F.col("_known").isNull()
    final = F.when(lost & F.col("_first").isNotNull(), F.col("_first")).otherwise(F.col("parsed_id"))
    reason = F.when(lost & F.col("_first").isNotNull(), "source_match").when(lost, "missing_in_corpus_no_source_match").otherwise("")
    return (
        rows.withColumn("final_id", final).withColumn("remap_reason", reason)
        .withColumn("remapped", (F.col("remap_reason") != "") & (F.col("final_id") != F.col("parsed_id")))
        .withColumn("parsed_in_corpus", F.col("_known").isNotNull())
        .withColumn("final_in_corpus", F.col("_known").isNotNull() | (lost & F.col("_first").isNotNull()))
        .drop("_known", "_first", "_source")
    )
