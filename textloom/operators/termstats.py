"""Corpus word statistics: frequencies, rarity, hints, sizes and corpus checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import text as tx
from textloom.functions.arrow import slices, split_words
from textloom.operators.skew import heavy_keys, top_n

# Words that are never useful as corpus keywords.
NOISE_WORDS = """
the and of to a in that is it as be for with by not on or from at this his their he was have are
but were they which so we an has been had will would all its our more upon can if may shall any who
what there said do no these those them my me us him her she i you your one two three four five six
seven eight nine ten mr let make just far old good way come day long know set read past high meet
get put take see give go think fact case line present general subject bill act world must much also
such other very well great same own than then now some like into time over out up down before after
between under through
""".split()


# Text whose words are counted at a time.
TASK_BYTES = 16 * 1024 * 1024


def term_table(docs: DataFrame, text: Column) -> DataFrame:
    """``term, raw_freq, doc_freq`` of a corpus.

    The words of some megabytes of text are counted where they lie, and only these counts are
    exchanged, so there is no (document, term) shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "words", limit=TASK_BYTES):
            sizes, words = split_words(part.column("words"))
            coded = words.dictionary_encode()
            terms, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            cells = pc.unique(pa.array(np.repeat(np.arange(len(sizes)), sizes) * max(len(terms), 1) + ids)).to_numpy()
            counts = [np.bincount(x, minlength=len(terms)) for x in (ids, cells % max(len(terms), 1))]
            yield pa.RecordBatch.from_arrays([terms, *map(pa.array, counts)], ["term", "raw", "doc"])

    counted = docs.select(F.coalesce(tx.ascii_gaps(F.lower(text)), F.lit("")).alias("words")).mapInArrow(run, "term string, raw bigint, doc bigint")
    return counted.groupBy("term").agg(F.sum("raw").alias("raw_freq"), F.sum("doc").alias("doc_freq"))


def relative_frequency(terms: DataFrame) -> DataFrame:
    total = terms.select(F.sum("raw_freq")).scalar()
    return terms.withColumn("rel_freq", F.col("raw_freq") / total)


def content_words(terms: DataFrame, noise: list[str] | None = None) -> DataFrame:
    """Drop noise words, numbers and words of up to three characters."""
    noise = NOISE_WORDS if noise is None else noise
    term = F.col("term")
    return terms.filter(
        ~F.lower(term).isin(noise) & ~term.rlike(r"^[\d,.\-/%]+$") & (F.length(term) > 3)
    )


def rarity_band(raw_freq: Column, doc_freq: Column) -> Column:
    return F.when(raw_freq.between(5, 75) & (doc_freq >= 2), "rare").when(raw_freq.between(1, 4), "very_rare")


def keyword_class(raw_freq: Column, weight: Column) -> Column:
    """Quality of a weighted keyword; the order of the rules matters."""
    f = F.coalesce(raw_freq, F.lit(0))
    return (
        F.when(f == 0, "ABSENT")
        .when((f <= 14) & (weight >= 15), "STRONG")
        .when((f <= 50) & (weight >= 8), "OK")
        .when((f > 50) & (weight >= 15), "WEAK")
        .otherwise("OK")
    )


def rare_hints(chunks: DataFrame, chunk_id: str, text: Column, terms: DataFrame, n: int = 20) -> DataFrame:
    """Up to ``n`` rare words per chunk, rare before very rare, then alphabetical.

    Words holding a share of the corpus are removed by a small broadcast set before the
    shuffle; what is left to join is rare by definition (at most 75 occurrences).
    """
    band = rarity_band(F.col("raw_freq"), F.col("doc_freq"))
    rare = content_words(terms).withColumn("band", band).filter("band is not null").select("term", "band")
    frequent = heavy_keys(terms, "term", "raw_freq", 1000).join(rare, "term", "left_anti")
    # \b[a-z]{4,}\b: whole runs of word characters that are all plain letters.
    plain = F.filter(F.array_distinct(tx.word_runs(text)), lambda w: w.rlike("^[a-z]{4,}$"))
    words = chunks.select(chunk_id, F.explode(plain).alias("term"))
    hits = words.join(F.broadcast(frequent), "term", "left_anti").join(rare, "term")
    ordered = F.array_sort(F.collect_list(F.struct("band", "term")))
    hints = hits.groupBy(chunk_id).agg(F.slice(ordered, 1, n).alias("h"))
    listed = hints.select(chunk_id, F.array_join(F.transform("h", lambda x: x["term"]), ", ").alias("hint"))
    return chunks.select(chunk_id).join(listed, chunk_id, "left").withColumn(
        "hint", F.coalesce("hint", F.lit("none identified"))
    )


# Bucket limits of the chunk size report, lower bound included.
SIZE_LIMITS = [0, 200, 400, 600, 800, 1000, 1500]


def size_histogram(chunks: DataFrame, text: Column) -> DataFrame:
    sizes = chunks.select(F.length(text).alias("size"))
    low = F.lit(SIZE_LIMITS[0])
    for limit in SIZE_LIMITS[1:]:
        low = F.when(F.col("size") >= limit, F.lit(limit)).otherwise(low)
    counts = sizes.groupBy(low.cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / counts.select(F.sum("n")).scalar())


def size_stats(chunks: DataFrame, text: Column, limit: int = 1500) -> DataFrame:
    size = F.length(text).cast("long")
    return chunks.agg(
        F.count("*").alias("n"), F.avg(size).alias("mean_size"), F.min(size).alias("min_size"),
        F.max(size).alias("max_size"), F.count_if(size > limit).alias("n_over"),
    )


def reconcile_words(
    raw: DataFrame, chunks: DataFrame, source: str, raw_text: Column, chunk_text: Column, tolerance: int = 5
) -> DataFrame:
    """Words per source before and after chunking, with a pass flag."""
    expected = raw.groupBy(source).agg(F.sum(tx.word_count(raw_text)).alias("expected"))
    actual = chunks.groupBy(source).agg(F.sum(tx.word_count(chunk_text)).alias("actual"), F.count("*").alias("n_chunks"))
    joined = expected.join(actual, source, "full")
    for c in ("expected", "actual", "n_chunks"):
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0)))
    diff = F.col("expected") - F.col("actual")
    return joined.withColumn("diff", diff).withColumn("ok", F.abs(diff) <= tolerance)


def reconcile_fixed(actual: DataFrame, expected: DataFrame, source: str, tolerance: int = 0) -> DataFrame:
    """Same comparison against a table ``source, expected``."""
    joined = expected.join(actual, source, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.withColumn("ok", F.abs(F.col("expected") - F.col("actual")) <= tolerance)


def structural_checks(
    chunks: DataFrame, chunk_id: str, text: Column, embedding: str | None = None, dimension: int = 1536,
    exported: DataFrame | None = None,
) -> DataFrame:
    """One row per check: ``check, failing, passed``."""
    n, distinct = F.count("*"), F.countDistinct(chunk_id)
    gaps = F.greatest(F.max(chunk_id) + 1, n) - distinct + F.least(F.min(chunk_id), F.lit(0)) * -1
    facts = [
        gaps.cast("long").alias("sequential_ids"),
        F.count_if(F.coalesce(tx.strip(text), F.lit("")) == "").alias("empty_text"),
    ]
    if embedding:
        facts.append(F.count_if(F.coalesce(F.size(embedding), F.lit(-1)) != dimension).alias("vector_length"))
    row = chunks.agg(*facts)
    if exported is not None:
        row = row.withColumn("export_count", F.abs(chunks.select(F.count("*")).scalar() - exported.select(F.count("*")).scalar()))
    names = row.columns
    pairs = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("failing")) for c in names])
    return row.select(F.inline(pairs)).withColumn("passed", F.col("failing") == 0)


def source_type_counts(chunks: DataFrame, source_type: str) -> DataFrame:
    return chunks.groupBy(source_type).agg(F.count("*").alias("n"))


def phrase_report(phrases: DataFrame, hits: DataFrame, phrase_id: str, chunk_id: str, n: int = 3) -> DataFrame:
    """Per phrase: number of chunks, the first ``n`` of them, and whether any was found."""
    counts = hits.groupBy(phrase_id).agg(F.count("*").alias("n_chunks"))
    first = (
        top_n(hits, [phrase_id], [F.col(chunk_id)], n)
        .groupBy(phrase_id)
        .agg(F.array_sort(F.collect_list(chunk_id)).alias("first_chunks"))
    )
    return (
        phrases.select(phrase_id).join(counts, phrase_id, "left").join(first, phrase_id, "left")
        .withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
        .withColumn("found", F.col("n_chunks") > 0)
    )
