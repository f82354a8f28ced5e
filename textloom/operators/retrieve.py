"""One retrieval for a table of queries: keyword, vector and late-interaction hits, united, deduplicated and reranked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators import fusion

COLUMNS = ["query_id", "text_id", "search_type", "rank", "score", "source", "summary", "key_quote", "top_segment"]


def _hits(found: DataFrame, search_type: str, **columns: Column) -> DataFrame:
    given = {
        "text_id": F.concat(F.lit("Text #: "), F.col("chunk_id")), "search_type": F.lit(search_type), "rank": F.col("rank").cast("long"),
    } | columns
    nothing = F.lit(None).cast("string")
    return found.select(*[given.get(c, F.col(c) if c in found.columns else nothing).alias(c) for c in COLUMNS])


def keyword_hits(found: DataFrame) -> DataFrame:
    """Hits of ``keyword.keyword_search``."""
    return _hits(found, "Keyword", key_quote=F.col("quote"))


def vector_hits(found: DataFrame) -> DataFrame:
    """Hits of ``vector.cosine_top``."""
    return _hits(found, "Semantic", score=F.col("similarity"))


def late_interaction_hits(found: DataFrame) -> DataFrame:
    """Hits of ``vector.late_interaction_top``."""
    return _hits(found, "ColBERT")


def retrieve(
    searches: list[DataFrame], corpus: DataFrame, relevance: Callable[[DataFrame], DataFrame], n: int = 15, policy: str = "first",
) -> DataFrame:
    """The best ``n`` texts per query: ``query_id, rank, search_type, text_id, source, summary, full_text, relevance``.

    ``searches``: hits in the form of the functions above; one hit per query and text stays, by
    ``policy``. ``corpus``: text_id, source, full_text. ``relevance`` takes the candidate documents
    and gives ``query_id, text_id, relevance``, as a rerank model would.
    """
    kept = fusion.dedupe_hits(fusion.union_hits(*searches), policy)
    documents = fusion.candidate_documents(kept, corpus)
    return fusion.rerank(documents.drop("document"), relevance(documents), n)
