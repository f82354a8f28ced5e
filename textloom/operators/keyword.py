"""Inverse-frequency keyword retrieval for a whole table of queries at once.

``plans`` holds one row per query: ``query_id, weighted_keywords map<string,double>,
year_keywords array<int>, text_keywords array<string>``. ``corpus`` holds ``chunk_id, source,
full_text, summary, keywords array<string>``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from textloom.functions import text as tx
from textloom.functions.arrow import slices, split_words
from textloom.operators.skew import broadcast_if_small, heavy_keys, keep_ids, salted_join, table_bytes, top_n
from textloom.session import BROADCAST_LIMIT, cut_lineage

# Lifts for a matching year and a matching source label, by mode.
BOOSTS = {"multiply": (1.5, 1.8), "add": (5.0, 8.0)}
CONTEXT = 300
METADATA_NOTE = "[match in metadata] "


def override_keywords(plans: DataFrame, manual: DataFrame) -> DataFrame:
    """Where a user gives a keyword map, their keywords, years and texts replace the planned ones as a set."""
    cols = ["weighted_keywords", "year_keywords", "text_keywords"]
    mine = manual.select("query_id", *[F.col(c).alias(f"_{c}") for c in cols])
    given = F.col("_weighted_keywords").isNotNull()
    joined = plans.join(mine, "query_id", "left")
    return joined.select(
        *[F.when(given, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in plans.columns]
    )


def keyword_weights(plans: DataFrame, terms: DataFrame, absent: str = "min") -> DataFrame:
    """``query_id, keyword, key, user_weight, weight``: inverse relative frequency, 10 for the rarest per query.

    A keyword the term table lacks counts as rare as the rarest term (``absent="min"``) or as
    frequent as the whole corpus (``absent="one"``).
    """
    kw = plans.select("query_id", F.explode("weighted_keywords").alias("keyword", "user_weight"))
    kw = kw.withColumn("key", tx.strip(F.lower("keyword"))).filter("key <> ''")
    small = broadcast_if_small(kw)
    # The term table is the big side: reduce it to the asked terms before anything else. The
    # corpus total cancels out of weight / largest weight, so raw frequencies are enough.
    # Stored once, as it is read twice and often the result of a scan of all texts.
    known = cut_lineage(terms.select(F.lower("term").alias("key"), "raw_freq"), "frequencies")
    rarest = known.select(F.min("raw_freq") if absent == "min" else F.sum("raw_freq")).scalar()
    asked = known.join(small.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max("raw_freq").alias("raw_freq"))
    raw = kw.join(asked, "key", "left").withColumn("f", F.coalesce("raw_freq", rarest, F.lit(1)))
    top = raw.groupBy("query_id").agg(F.min("f").alias("least"))
    weights = raw.join(top, "query_id").select(
        "query_id", "keyword", "key", "user_weight", (F.col("least") / F.col("f") * 10).alias("weight")
    )
    # Small, used by every later step and dependent on the whole corpus: stored once.
    return cut_lineage(weights, "keyword-weights")


def searched_text() -> Column:
    return F.concat_ws(
        " ", F.lower(F.coalesce("full_text", F.lit(""))), F.lower(F.coalesce("summary", F.lit(""))),
        F.lower(F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")),
    )


def _word_pairs(runs: Column) -> Column:
    """Every word of a list of runs (``ANY_RUN``) with the gap and the word behind it, as one string each.

    Occurrences of one pair do not overlap, which only a pair of equal words could: of these the first counts.
    """
    first = F.when(F.regexp_like(F.coalesce(F.get(runs, F.lit(0)), F.lit("")), F.lit(f"^{tx.WORD_RUN}$")), 0).otherwise(1)
    starts = F.when(F.size(runs) - first >= 3, F.sequence(first, F.size(runs) - 3, F.lit(2)))
    starts = F.coalesce(starts, F.array().cast("array<int>"))

    def apart(kept: Column, i: Column) -> Column:
        overlaps = (F.size(kept) > 0) & (F.element_at(kept, -1) == i - 2) & (F.get(runs, i - 1) == F.get(runs, i + 1))
        return F.when(overlaps, kept).otherwise(F.array_append(kept, i))

    equal = F.filter(starts, lambda i: F.get(runs, i) == F.get(runs, i + 2))
    others = F.filter(starts, lambda i: F.get(runs, i) != F.get(runs, i + 2))
    places = F.concat(others, F.aggregate(equal, F.array().cast("array<int>"), apart))
    return F.transform(places, lambda i: F.concat(F.get(runs, i), F.get(runs, i + 1), F.get(runs, i + 2)))


def _any_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(tx.ANY_RUN), F.lit(0))


def _is_direct(key: Column) -> Column:
    """True for one word, and for two words with a gap."""
    def two(runs: Column) -> Column:
        return (F.size(runs) == 3) & F.regexp_like(runs[0], F.lit(f"^{tx.WORD_RUN}$"))

    return key.rlike(f"^{tx.WORD_RUN}$") | tx.let(_any_runs(key), two)


def _word_counts(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """``chunk_id, source, key, n`` of words, counted where the text lies. A table of keys that fits a broadcast."""
    names = pa.array([r["key"] for r in keys.collect()], pa.string())
    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in ("chunk_id", "source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body"):
            sizes, words = split_words(part.column("body"))
            at = pc.index_in(words, value_set=names).fill_null(-1).to_numpy()
            cells = np.repeat(np.arange(len(sizes)), sizes) * len(names) + at
            cells, n = pc.value_counts(pa.array(cells[at >= 0])).flatten()
            row, key = np.divmod(cells.to_numpy(), max(len(names), 1))
            found = [part.column(c).take(pa.array(row)) for c in ("chunk_id", "source")]
            yield pa.RecordBatch.from_arrays([*found, names.take(pa.array(key)), n], ["chunk_id", "source", "key", "n"])

    return chunks.select("chunk_id", "source", tx.ascii_gaps(F.lower("body")).alias("body")).mapInArrow(run, f"{kinds}, key string, n bigint")


def _direct_counts(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """``chunk_id, source, key, n`` of words and word pairs. What nobody asks for leaves before the shuffle."""
    one_word = F.col("key").rlike(f"^{tx.WORD_RUN}$")
    if keys.filter(~one_word).isEmpty() and table_bytes(keys) <= BROADCAST_LIMIT:
        return _word_counts(chunks, keys)
    asked = broadcast_if_small(keys)
    parts = tx.word_runs(F.col("body"))
    if not keys.filter(~one_word).isEmpty():
        parts = F.concat(parts, tx.let(_any_runs(F.col("body")), _word_pairs))
        if keys.filter(one_word).isEmpty():
            parts = tx.let(_any_runs(F.col("body")), _word_pairs)
    tokens = chunks.select("chunk_id", "source", F.explode(parts).alias("key"))
    counts = tokens.join(asked, "key", "left_semi").groupBy("chunk_id", "source", "key").agg(F.count("*").alias("n"))
    return counts.filter(one_word | F.col("chunk_id").isNotNull())


def _phrase_counts(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Counts of other keywords, tested only where their longest pair of words (or word) occurs."""
    def longest(parts: Column) -> Column:
        return F.array_max(F.transform(parts, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]

    runs = F.regexp_extract_all("key", F.lit(tx.WORD_RUN), F.lit(0))
    # The boundaries make every run of a keyword a complete run of the text.
    anchored = keys.withColumn("anchor", F.coalesce(longest(tx.let(_any_runs(F.col("key")), _word_pairs)), longest(runs), "key"))
    words = F.array_distinct(tx.word_runs(F.col("body")))
    # A keyword without any word must fill the gap between two words completely.
    gaps = F.regexp_extract_all(
        F.col("body"), F.lit(rf"(?<=[{tx.WORD_CHAR}])[^{tx.WORD_CHAR}]+(?=[{tx.WORD_CHAR}])"), F.lit(0)
    )
    pairs = F.array_distinct(tx.let(_any_runs(F.col("body")), _word_pairs))
    near = (
        chunks.select("chunk_id", F.explode(F.concat(words, F.array_distinct(gaps), pairs)).alias("anchor"))
        .join(broadcast_if_small(anchored), "anchor").select("chunk_id", "key").distinct()
    )
    near = cut_lineage(near, "phrase-candidates")
    # Texts without a candidate leave before the join. The plain substring test is much cheaper than the
    # pattern and settles most pairs.
    holding = near.join(keep_ids(chunks, "chunk_id", near), "chunk_id").filter(F.contains("body", F.col("key")))
    counted = holding.select(
        "chunk_id", "source", "key", F.regexp_count("body", tx.whole_word_pattern(F.col("key"))).cast("long").alias("n")
    )
    return counted.filter("n > 0").groupBy("chunk_id", "source", "key").agg(F.sum("n").alias("n"))


# Counts of a keyword in a chunk that one task takes on average, and matches with a query that it holds at a time.
TASK_MATCHES = 256 * 1024
BLOCK_MATCHES = 2 * 1024 * 1024


def _leaders(sums: np.ndarray, source: np.ndarray, best: int) -> np.ndarray:
    """Marks the positive sums (chunks times queries) that may be among the first ``best`` of their query.

    Chunks of one source meet the same constraints, whose lifts keep the order of scores. Sums equal to the
    last of the ``best`` stay, also where they differ by less than the digits that are compared.
    """
    keep = sums != 0
    order = np.argsort(source, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(source[order])) + 1, len(order))
    for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
        if b - a > best:
            own = sums[order[a:b]]
            least = np.partition(own, -best, axis=0)[-best]
            keep[order[a:b]] &= own >= least - 1e-8 - 1e-12 * np.abs(least)
    return keep


def _scored(counts: DataFrame, kw: DataFrame, strict: bool, best: int | None = None) -> DataFrame:
    """``chunk_id, source, found array<query_id, score>``: sums of ``n * weight``, or with ``strict`` ``n * n * weight``.

    All counts of a chunk lie in one partition. With ``best`` only what ``_leaders`` marks.
    """
    asked = kw.select("query_id", "key", "weight").toArrow().combine_chunks()
    asked = asked.sort_by("key")
    queries = asked.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    keys = asked.column("key").combine_chunks().dictionary_encode()  # sorted, so numbered in the order of the rows
    names, ids = keys.dictionary, queries.dictionary
    first = np.searchsorted(keys.indices.to_numpy(), np.arange(len(names) + 1))
    query, weight = queries.indices.to_numpy().astype(np.int64), asked.column("weight").to_numpy()
    kinds = {c: counts.schema[c].dataType.simpleString() for c in ("chunk_id", "source")}
    kinds["found"] = f"array<struct<query_id:{kw.schema['query_id'].dataType.simpleString()},score:double>>"
    n_keys, n_queries = max(len(names), 1), max(len(ids), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        chunk, source = (table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("chunk_id", "source"))
        n_sources = len(source.dictionary)
        chunks, row = np.unique(chunk.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy(), return_inverse=True)
        key = pc.index_in(table.column("key").combine_chunks(), value_set=names).fill_null(-1).to_numpy()
        known = key >= 0
        cells, at = np.unique(row[known] * n_keys + key[known], return_inverse=True)
        n = np.bincount(at, table.column("n").to_numpy()[known], minlength=len(cells))
        n = n * n if strict else n
        row, key = np.divmod(cells, n_keys)
        each = first[key + 1] - first[key]
        before = np.concatenate([[0], np.cumsum(each)])  # matches before each count
        starts = np.searchsorted(row, np.arange(len(chunks) + 1))
        a = 0
        while a < len(chunks):
            b = int(np.searchsorted(before[starts], before[starts[a]] + BLOCK_MATCHES, "right")) - 1
            b = min(max(a + 1, min(b, a + BLOCK_MATCHES // n_queries)), len(chunks))
            x, y = starts[a], starts[b]
            match = np.repeat(np.arange(x, y), each[x:y])
            place = np.arange(before[x], before[y]) - before[match] + first[key[match]]
            sums = np.bincount((row[match] - a) * n_queries + query[place], n[match] * weight[place], minlength=(b - a) * n_queries)
            hit = np.flatnonzero(sums if best is None else _leaders(sums.reshape(b - a, n_queries), chunks[a:b] % n_sources, best))
            ends = np.searchsorted(hit, np.arange(b - a + 1) * n_queries)
            found = pa.StructArray.from_arrays([ids.take(pa.array(hit % n_queries)), pa.array(sums[hit])], ["query_id", "score"])
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.dictionary.take(pa.array(chunks[a:b] // n_sources)), source.dictionary.take(pa.array(chunks[a:b] % n_sources)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found),
                ],
                ["chunk_id", "source", "found"],
            )
            a = b

    return counts.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def keyword_scores(
    corpus: DataFrame, weights: DataFrame, strict: bool = False, labelled: bool = False, best: int | None = None
) -> DataFrame:
    """``query_id, chunk_id, source, score`` for every query and chunk with a positive score.

    score = sum of count * weight; with ``strict`` each occurrence adds the whole count, which
    makes it the sum of count * count * weight. ``labelled`` adds the ``label`` of the source that the
    constraints look at, which is found once per chunk and not for each of its queries. With ``best``, scores that
    cannot be among the first ``best`` of a query, whatever its constraints, may be left out (for ``ranked_hits``).

    The counts of a chunk meet the weights of all queries in one task, and are summed there: nothing of the
    size of queries times chunks is shuffled.
    """
    chunks = corpus.select("chunk_id", "source", searched_text().alias("body"))
    kw = weights.select("query_id", "keyword", "key", "weight").filter("weight > 0")
    if strict:
        kw = kw.groupBy("query_id", "keyword", "key").agg(F.count("*").alias("copies"), F.max("weight").alias("weight"))
    keys = kw.select("key").distinct().withColumn("direct", _is_direct(F.col("key")))
    counts = _direct_counts(chunks, keys.filter("direct").select("key"))
    others = keys.filter("not direct").select("key")
    if not others.isEmpty():
        counts = counts.unionByName(_phrase_counts(chunks, others))
    counts = cut_lineage(counts, "keyword-counts")
    if table_bytes(kw) <= BROADCAST_LIMIT:
        parts = max(corpus.sparkSession.sparkContext.defaultParallelism, counts.count() // TASK_MATCHES + 1)
        squared = kw.withColumn("weight", F.col("weight") * F.col("copies") * F.col("copies")) if strict else kw
        by_chunk = _scored(counts.repartition(parts, "chunk_id", "source"), squared, strict, best)
        label = [tx.source_key(F.col("source")).alias("label")] if labelled else []
        rows = by_chunk.select("chunk_id", "source", *label, "found").select("*", F.inline("found"))
        return rows.select("query_id", "chunk_id", "source", "score", *(["label"] if labelled else []))
    counts = counts.groupBy("chunk_id", "source", "key").agg(F.sum("n").alias("n"))
    load = counts.groupBy("key").agg(F.count("*").alias("df"))
    matches = salted_join(counts, kw, "key", heavy_keys(load, "key", "df"), F.col("chunk_id"))
    if strict:
        matches = matches.withColumn("n", (F.col("n") * F.col("copies")) * (F.col("n") * F.col("copies")))
    scores = matches.groupBy("query_id", "chunk_id", "source").agg(F.sum(F.col("n") * F.col("weight")).alias("score"))
    return scores.withColumn("label", tx.source_key(F.col("source"))) if labelled else scores


def _constraints(plans: DataFrame) -> DataFrame:
    """``query_id, years, texts, labels`` with the empty lists filled in."""
    none = F.array().cast("array<string>")
    texts = F.coalesce(tx.trimmed_list(F.col("text_keywords")), none)
    return plans.select(
        "query_id",
        F.coalesce(F.col("year_keywords").cast("array<string>"), none).alias("years"),
        texts.alias("texts"),
        F.filter(F.transform(texts, tx.source_key), lambda k: k != "").alias("labels"),
    )


def constrained(scores: DataFrame, plans: DataFrame, boost: str = "multiply") -> DataFrame:
    """Apply the year and source constraints; an empty constraint counts as met.

    ``multiply`` and ``add`` raise the score and set the priority ``bucket``; ``strict`` drops
    what does not match. A column ``label`` (``keyword_scores(labelled=True)``) is taken as the source's key.
    """
    wanted = broadcast_if_small(_constraints(plans))
    joined = scores.join(wanted, "query_id")
    label = F.col("_label")
    if boost == "strict":
        joined = joined.withColumn("_label", F.lower("source"))
        year = (F.size("years") == 0) | F.exists("years", lambda y: F.contains(label, y))
        text = (F.size("texts") == 0) | F.exists(
            "texts", lambda t: F.regexp_like(label, tx.whole_word_pattern(F.lower(t)))
        )
        kept = joined.filter(year & text)
        return kept.withColumn("bucket", F.lit(0)).drop("years", "texts", "labels", "label", "_label")
    joined = joined.withColumn("_label", F.col("label") if "label" in scores.columns else tx.source_key(F.col("source")))
    year = (F.size("years") == 0) | F.exists("years", lambda y: F.contains(label, y))
    text = (F.size("labels") == 0) | F.exists("labels", lambda t: F.contains(label, t))
    by_year, by_text = BOOSTS[boost]
    score = F.col("score")
    if boost == "multiply":
        score = score * F.when(year, by_year).otherwise(1.0) * F.when(text, by_text).otherwise(1.0)
    else:
        score = score + F.when(year, by_year).otherwise(0.0) + F.when(text, by_text).otherwise(0.0)
    bucket = F.when(year & text, 0).when(year, 1).otherwise(2)
    return joined.withColumn("score", score).withColumn("bucket", bucket).drop("years", "texts", "labels", "label", "_label")


def ranked_hits(scored: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` per query: bucket, then score, then corpus order. Scores are compared to 9 digits."""
    order = [F.col("bucket"), F.round("score", 9).desc(), F.col("chunk_id")]
    return top_n(scored, ["query_id"], order, n)


@pandas_udf(IntegerType())
def _densest(text: pd.Series, keywords: pd.Series, weights: pd.Series) -> pd.Series:
    """Centre of the 200 characters with the largest total keyword weight; null without a match."""
    half = 100

    def centre(body: str, keys: list[str], values: list[float]) -> int | None:
        worth: dict[str, float] = {}
        for k, v in zip(keys, values):
            worth[k] = worth.get(k, 0.0) + v
        hits = [(m.start(), worth[m.group()]) for m in re.finditer(r"[^\W]+", body) if m.group() in worth]
        for k in worth:
            if not re.fullmatch(r"\w+", k):
                hits += [(m.start(), worth[k]) for m in re.finditer(rf"\b{re.escape(k)}\b", body)]
        if not hits:
            return None
        hits.sort()
        at = np.array([p for p, _ in hits])
        total = np.concatenate([[0.0], np.cumsum([w for _, w in hits])])
        starts = np.unique(np.maximum(at - half, 0))
        inside = total[np.searchsorted(at, starts + 2 * half)] - total[np.searchsorted(at, starts)]
        return int(starts[np.argmax(np.round(inside, 6))] + half)

    return pd.Series([centre(t or "", list(k), list(w)) for t, k, w in zip(text, keywords, weights)], dtype="Int64")


def _around(text: Column, centre: Column) -> Column:
    start = F.greatest(centre - CONTEXT, F.lit(0))
    return F.replace(F.substring(text, start + 1, centre + CONTEXT - start), F.lit("\n"), F.lit(" "))


def _query_keywords(weights: DataFrame) -> DataFrame:
    """The keywords of a query as one array (a query plan's own map, so of its size)."""
    return weights.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("keyword", "key", "weight", "user_weight"))).alias("kw")
    )


def with_snippets(hits: DataFrame, corpus: DataFrame, weights: DataFrame, boost: str = "multiply") -> DataFrame:
    """Add quote, summary and per-keyword counts. Reads only the texts of the top hits."""
    hits = cut_lineage(hits, "hits")
    texts = keep_ids(corpus.select("chunk_id", "full_text", "summary", "keywords"), "chunk_id", hits)
    rows = hits.join(texts, "chunk_id").join(_query_keywords(weights), "query_id")
    counts = tx.let(
        searched_text(),
        lambda body: F.transform(
            "kw",
            lambda k: F.struct(
                k["keyword"].alias("keyword"), F.regexp_count(body, tx.whole_word_pattern(k["key"])).cast("long").alias("n")
            ),
        ),
    )
    rows = rows.withColumn("keyword_counts", F.map_from_entries(F.filter(counts, lambda c: c["n"] > 0)))
    full = F.col("full_text")
    if boost == "multiply":
        used = F.filter("kw", lambda k: k["weight"] > 0)
        rows = rows.withColumn(
            "_centre",
            _densest(F.lower(full), F.transform(used, lambda k: k["key"]), F.transform(used, lambda k: k["weight"])),
        )
        note = F.concat(F.lit(METADATA_NOTE), F.replace(F.left(full, F.lit(2 * CONTEXT)), F.lit("\n"), F.lit(" ")))
        quote = F.when(F.col("_centre").isNotNull(), _around(full, F.col("_centre"))).otherwise(note)
    else:
        # Earliest place of the heaviest user keyword that occurs.
        places = tx.let(
            F.lower(full) if boost == "add" else searched_text(),
            lambda where: F.transform(
                "kw",
                lambda k: F.struct(
                    k["user_weight"].alias("w"),
                    (-F.regexp_instr(where, tx.whole_word_pattern(k["key"]))).alias("neg"),
                ),
            ),
        )
        best = F.array_max(F.filter(places, lambda p: p["neg"] < 0))
        quote = _around(full, F.coalesce(-best["neg"] - 1, F.lit(0)))
    rows = rows.withColumn("quote", quote).withColumn("summary", F.coalesce("summary", F.lit("")))
    return rows.drop("_centre", "kw", "keywords", "full_text", "bucket")


def keyword_search(corpus: DataFrame, terms: DataFrame, plans: DataFrame, n: int = 5, boost: str = "multiply") -> DataFrame:
    """Ranked keyword hits with snippets for every query plan.

    ``boost``: ``multiply`` (current rules), ``add`` (flat lifts, snippet at the heaviest
    keyword) or ``strict`` (constraints filter, counts squared).
    """
    weights = keyword_weights(plans, terms, "min" if boost == "multiply" else "one")
    scores = keyword_scores(corpus, weights, strict=boost == "strict", labelled=boost != "strict", best=n)
    hits = ranked_hits(constrained(scores, plans, boost), n)
    return with_snippets(hits, corpus, weights, boost)


# ---- query text ---------------------------------------------------------------------------

# Basic English stopwords, and words every query about this kind of corpus uses.
QUERY_STOPWORDS = [
    "a", "an", "the", "in", "on", "at", "for", "to", "of", "with", "by",
    "and", "or", "but", "if", "then", "else", "when", "up", "down", "out",
    "is", "am", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should",
    "this", "that", "these", "those", "there", "here",
]
DOMAIN_WORDS = [
    "abraham", "lincoln", "abe", "president", "mr", "mrs",
    "presidential", "presidency", "white", "house",
]


def stopword_set(extra: list[str] = (), removed: list[str] = ()) -> list[str]:
    gone = set(removed)
    return [w for w in dict.fromkeys([*QUERY_STOPWORDS, *DOMAIN_WORDS, *extra]) if w not in gone]


def filtered_query(query: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case query without stopwords and non-alphanumeric tokens; unchanged if nothing is left."""
    words = stopword_set() if stopwords is None else list(stopwords)
    kept = F.filter(
        tx.split_words(F.lower(query)), lambda w: ~w.isin(words) & w.rlike(r"^[\p{L}\p{N}]+$")
    )
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(query)


def expanded_query(query: Column, initial_answer: Column) -> Column:
    """Vector-search text: the query directly followed by the drafted answer."""
    return F.concat(query, F.coalesce(initial_answer, F.lit("")))
