"""Retrieval metrics over ``hits(query_id, chunk_id, rank)`` and ``qrels(query_id, chunk_id)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def relevance(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Full outer join: every hit and every ideal chunk, with ``retrieved`` and ``ideal`` flags."""
    h = hits.withColumn("retrieved", F.lit(True))
    q = qrels.select("query_id", "chunk_id", F.lit(True).alias("ideal")).distinct()
    both = h.join(q, ["query_id", "chunk_id"], "full")
    return both.withColumn("retrieved", F.coalesce("retrieved", F.lit(False))).withColumn(
        "ideal", F.coalesce("ideal", F.lit(False))
    )


def precision_recall(hits: DataFrame, qrels: DataFrame, k: int | None = None) -> DataFrame:
    """Precision, recall and precision relative to its ceiling, rounded to 4 digits.

    ``k=None`` divides precision by the length of the retrieved list, a number by ``k``.
    """
    used = hits if k is None else hits.filter(F.col("rank") <= k)
    per = relevance(used, qrels).groupBy("query_id").agg(
        F.count_if("retrieved").alias("n_retrieved"),
        F.countDistinct(F.when(F.col("retrieved") & F.col("ideal"), F.col("chunk_id"))).alias("n_hit"),
        F.countDistinct(F.when(F.col("ideal"), F.col("chunk_id"))).alias("n_ideal"),
    )
    size = F.col("n_retrieved") if k is None else F.lit(k)
    p = F.when(size > 0, F.col("n_hit") / size).otherwise(0.0)
    r = F.when(F.col("n_ideal") > 0, F.col("n_hit") / F.col("n_ideal")).otherwise(0.0)
    ceiling = F.when(size > 0, F.least("n_ideal", size) / size).otherwise(0.0)
    return per.select(
        "query_id", "n_retrieved", "n_hit", "n_ideal", (F.col("n_ideal") - F.col("n_hit")).alias("n_missed"),
        F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
        F.round(F.when(ceiling > 0, p / ceiling).otherwise(0.0), 4).alias("ceiling_precision"),
    )


def hit_and_miss(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """The ideal chunks of each query as rows, with ``status`` hit or missed."""
    ideal = relevance(hits.select("query_id", "chunk_id").distinct(), qrels).filter("ideal")
    return ideal.select("query_id", "chunk_id", F.when(F.col("retrieved"), "hit").otherwise("missed").alias("status"))


def detect_id_set(hits: DataFrame, original: DataFrame) -> DataFrame:
    """``query_id, id_set``: original if any retrieved id is one of the original ideal ids, else new."""
    orig = original.select("query_id", "chunk_id", F.lit(True).alias("_orig")).distinct()
    return (
        hits.join(orig, ["query_id", "chunk_id"], "left").groupBy("query_id")
        .agg(F.bool_or(F.coalesce("_orig", F.lit(False))).alias("_any"))
        .select("query_id", F.when(F.col("_any"), "original").otherwise("new").alias("id_set"))
    )


def chosen_qrels(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """The set of ``qrels(query_id, chunk_id, id_set)`` that fits each query's retrieved ids."""
    kind = detect_id_set(hits, qrels.filter("id_set = 'original'"))
    asked = qrels.join(kind.withColumnRenamed("id_set", "_use"), "query_id", "left")
    return asked.filter(F.col("id_set") == F.coalesce("_use", F.lit("new"))).select("query_id", "chunk_id", "id_set")


def _discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1)


def ranking_metrics(
    hits: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5), ideal: str = "all"
) -> DataFrame:
    """MRR, nDCG and precision and recall at each k, one row per query with hits.

    ``ideal="retrieved"`` normalises nDCG by the best order of what was retrieved only;
    ``"all"`` by the best list of that length from all ideal chunks.
    """
    sizes = qrels.distinct().groupBy("query_id").agg(F.count("*").alias("n_ideal"))
    marked = hits.join(
        qrels.select("query_id", "chunk_id", F.lit(1).alias("rel")).distinct(), ["query_id", "chunk_id"], "left"
    ).withColumn("rel", F.coalesce("rel", F.lit(0)))
    aggs = [
        F.count("*").alias("n"),
        F.sum("rel").alias("n_rel"),
        F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.col("rel") * _discount(F.col("rank"))).alias("dcg"),
    ]
    aggs += [F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"_top{k}") for k in ks]
    per = marked.groupBy("query_id").agg(*aggs).join(sizes, "query_id", "left")
    n_ideal = F.coalesce("n_ideal", F.lit(0))
    best = F.col("n_rel") if ideal == "retrieved" else F.least(n_ideal, F.col("n"))
    ranks = F.when(best > 0, F.sequence(F.lit(1), best.cast("int")))
    top = F.aggregate(F.coalesce(ranks, F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + _discount(i))
    out = [F.col("query_id"), F.col("mrr"), F.when(top > 0, F.col("dcg") / top).otherwise(0.0).alias("ndcg")]
    for k in ks:
        out.append((F.col(f"_top{k}") / F.lit(k)).alias(f"p_at_{k}"))
        out.append(F.when(n_ideal > 0, F.col(f"_top{k}") / n_ideal).otherwise(0.0).alias(f"r_at_{k}"))
    return per.select(*out)


def metrics_by_search(hits: DataFrame, qrels: DataFrame, kinds: tuple[str, ...] = ("Keyword", "Semantic"), **kw) -> DataFrame:
    """``ranking_metrics`` of each search type's own list, re-ranked within the type."""
    out = None
    for kind in kinds:
        # A query's ranked list is at most as long as the reranker's n.
        w = Window.partitionBy("query_id").orderBy("rank")
        own = hits.filter(F.col("search_type") == kind).withColumn("rank", F.row_number().over(w))
        part = ranking_metrics(own, qrels, **kw).withColumn("search_type", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def path_composition(hits: DataFrame, k: int = 5) -> DataFrame:
    """Search types of the first k hits as text, and how many are keyword and semantic hits."""
    top = hits.filter(F.col("rank") <= k).withColumn("_t", F.coalesce(F.nullif(F.col("search_type"), F.lit("")), F.lit("Unknown")))
    per = top.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "_t"))).alias("p"),
        F.count_if(F.lower("_t") == "keyword").alias("n_keyword"),
        F.count_if(F.lower("_t") == "semantic").alias("n_semantic"),
    )
    return per.select("query_id", F.array_join(F.transform("p", lambda x: x["_t"]), ",").alias("path"), "n_keyword", "n_semantic")


def score_profile(hits: DataFrame, k: int = 5) -> DataFrame:
    """Range of the first k relevance scores and a warning when they are high and flat."""
    top = hits.filter(F.col("rank") <= k)
    source = F.nullif(F.coalesce("source", F.lit("")), F.lit(""))
    per = top.groupBy("query_id").agg(
        F.max("score").alias("hi"), F.min("score").alias("lo"), F.avg("score").alias("mean"),
        F.countDistinct(source).alias("n_src"), F.countDistinct("chunk_id").alias("n_ids"), F.count("*").alias("n"),
    )
    spread = F.round(F.col("hi") - F.col("lo"), 4)
    n_distinct = F.when(F.col("n_src") > 0, F.col("n_src")).when(F.col("n_ids") > 0, F.col("n_ids")).otherwise(F.col("n"))
    return per.select(
        "query_id", F.round("hi", 6).alias("score_max"), F.round("lo", 6).alias("score_min"),
        F.round("mean", 6).alias("score_mean"), spread.alias("spread"), n_distinct.alias("n_sources"),
        ((F.col("hi") >= 0.70) & (spread <= 0.08)).alias("calibration_warning"),
    )


def source_diversity(hits: DataFrame, corpus: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """Distinct sources among retrieved chunks, else among cited sources, else the number of ids.

    ``cited(query_id, source)`` holds the sources named by quote verification.
    """
    known = hits.join(corpus.select("chunk_id", F.trim("source").alias("_s")), "chunk_id", "left")
    per = known.groupBy("query_id").agg(
        F.countDistinct(F.nullif(F.col("_s"), F.lit(""))).alias("n_known"), F.count("*").alias("n_ids")
    )
    fallback = F.col("n_ids")
    if cited is not None:
        named = F.nullif(F.trim(F.replace(F.trim("source"), F.lit("Source:"), F.lit(""))), F.lit(""))
        quoted = cited.groupBy("query_id").agg(F.countDistinct(named).alias("n_cited"))
        per = per.join(quoted, "query_id", "left")
        fallback = F.when(F.col("n_cited") > 0, F.col("n_cited")).otherwise(fallback)
    return per.select("query_id", F.when(F.col("n_known") > 0, F.col("n_known")).otherwise(fallback).alias("n_sources"))


def expected_overlap(hits: DataFrame, expected: DataFrame, k: int = 3) -> DataFrame:
    """How many expected chunks are among the first k hits, with both totals."""
    both = relevance(hits.filter(F.col("rank") <= k), expected)
    return both.groupBy("query_id").agg(
        F.countDistinct(F.when(F.col("retrieved") & F.col("ideal"), F.col("chunk_id"))).alias("n_matched"),
        F.count_if("ideal").alias("n_expected"), F.count_if("retrieved").alias("n_retrieved"),
    )
