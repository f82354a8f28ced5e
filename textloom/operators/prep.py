"""Corpus preparation: from raw texts to numbered chunks and joined metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.functions import text as tx
from textloom.operators.numbering import running_offsets, with_neighbours
from textloom.operators.skew import broadcast_if_small, keep_ids


def lookup(rows: DataFrame, row_id: str, corpus: DataFrame, corpus_id: str, how: str = "left") -> DataFrame:
    """Find chunks by id whether it is written ``Text #: 7``, ``7`` or as a number."""
    left = rows.withColumn("_id", F.coalesce(tx.id_label(F.col(row_id)), F.lit("")))
    right = corpus.withColumn("_id", tx.id_label(F.col(corpus_id))).drop(corpus_id)
    return left.join(right, "_id", how).drop("_id")


def usable_texts(raw: DataFrame, text_id: str, text: str, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts to keep, and the rejected rows with a reason."""
    marked = raw.join(
        excluded.select(text_id, F.lit(True).alias("_out")).distinct(), text_id, "left"
    ).withColumn(
        "reason",
        F.when(F.col("_out"), "excluded").when(F.coalesce(tx.strip(F.col(text)), F.lit("")) == "", "empty"),
    ).drop("_out")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def override_labels(raw: DataFrame, text_id: str, source: str, fixes: DataFrame) -> DataFrame:
    """Replace sources by those of ``fixes(text_id, fixed_source)``; of several fixes of a text the largest counts."""
    fixes = broadcast_if_small(fixes.groupBy(text_id).agg(F.max("fixed_source").alias("fixed_source")))
    return (
        raw.join(fixes, text_id, "left")
        .withColumn(source, F.coalesce("fixed_source", source))
        .drop("fixed_source")
    )


def build_chunks(
    texts: DataFrame, text_no: str, source: str, text: str, separator: str = "\n\n",
    target: int = 700, limit: int = 900, lead: str = "the ",
) -> DataFrame:
    """Chunk every text and number the chunks 0, 1, 2, ... over the whole corpus.

    Only (text, number of chunks) rows take part in the prefix sum; texts never move.
    """
    pieces = texts.withColumn("_chunks", tx.chunk_text(F.col(text), separator, target, limit))
    counts = pieces.select(text_no, F.size("_chunks").cast("long").alias("_n"))
    offsets = running_offsets(counts, text_no, "_n")
    flat = pieces.withColumn("total_in_source", F.size("_chunks").cast("long")).select(
        text_no, source, "total_in_source", F.posexplode("_chunks").alias("position", "full_text")
    )
    label = tx.strip(F.regexp_replace(F.col(source), r"^Source:\s+", ""))
    return (
        flat.join(offsets, text_no)
        .withColumn("position", F.col("position").cast("long"))
        .withColumn("chunk_id", F.col("offset") + F.col("position"))
        .withColumn("text_id", F.concat(F.lit("Text #: "), F.col("chunk_id")))
        .withColumn(
            "chunk_context",
            F.format_string(
                f"From {lead}%s, passage %d of %d.", label, F.col("position") + 1, F.col("total_in_source")
            ),
        )
        .drop("offset")
    )


def neighbour_context(chunks: DataFrame, source_file: str, position: str, text: str, reach: int = 1) -> DataFrame:
    """Text of the chunk with its neighbours, in order, separated by blank lines."""
    near = with_neighbours(chunks, source_file, position, F.nullif(F.col(text), F.lit("")), reach, "_near")
    return near.withColumn("context", F.array_join("_near", "\n\n")).drop("_near")


def enrich(hits: DataFrame, corpus: DataFrame, chunk_id: str, columns: list[str]) -> DataFrame:
    """Add chunk columns to hits; '' where the chunk is unknown."""
    joined = hits.join(keep_ids(corpus.select(chunk_id, *columns), chunk_id, hits), chunk_id, "left")
    return joined.select(*hits.columns, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def signatures(corpus: DataFrame, chunk_id: str, source: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return corpus.select(
        chunk_id, F.col(source).alias("source"), F.length(body).cast("long").alias("len"),
        tx.fingerprint(body).alias("sha1_10"), tx.preview(body).alias("preview"),
    )


def index_drift(left: DataFrame, right: DataFrame, chunk_id: str) -> DataFrame:
    """Ids whose signature differs between two corpora, or which only one of them has."""
    a = left.select(chunk_id, F.col("sha1_10").alias("left_sha"), F.col("len").alias("left_len"))
    b = right.select(chunk_id, F.col("sha1_10").alias("right_sha"), F.col("len").alias("right_len"))
    both = a.join(b, chunk_id, "full")
    status = (
        F.when(F.col("left_sha").isNull(), "only_right")
        .when(F.col("right_sha").isNull(), "only_left")
        .when(F.col("left_sha") != F.col("right_sha"), "changed")
    )
    return both.withColumn("status", status).filter("status is not null")


def loadable(docs: DataFrame, doc_no: str, text: str, min_length: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rows an index can take, and the rejected rows, both with default ids ``doc_i``.

    ``i`` counts all rows in the order of ``doc_no``, so a rejected row leaves a gap.
    """
    ranks = running_offsets(docs.select(doc_no, F.lit(1).cast("long").alias("_n")), doc_no, "_n")
    named = docs.join(ranks, doc_no).withColumn("index_id", F.concat(F.lit("doc_"), F.col("offset"))).drop("offset")
    ok = F.coalesce(F.length(text), F.lit(0)) >= min_length
    return named.filter(ok), named.filter(~ok)
