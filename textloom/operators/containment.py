"""Substring joins without comparing every needle with every text.

If a needle occurs in a text, every word of the needle that touches neither end of it stands
in the text as a complete word. So needles meet texts in an equi-join on the rarest such
inner word. A needle without an inner word ("ery national") is first expanded, through one of
its outer runs, to the corpus vocabulary entries that end or start with that run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from textloom.functions import text as tx
from textloom.functions.arrow import slices, split_words
from textloom.operators.skew import broadcast_if_small, heavy_keys, keep_ids, salted_join, table_bytes
from textloom.session import BROADCAST_LIMIT, cut_lineage


def inner_words(c: Column) -> Column:
    """Distinct words of a needle that touch neither its start nor its end."""
    runs = F.regexp_extract_all(c, F.lit(tx.ANY_RUN), F.lit(0))
    inner = F.slice(runs, 2, F.greatest(F.size(runs) - 2, F.lit(0)))
    return F.array_distinct(F.filter(inner, lambda r: r.rlike(tx.WORD_RUN)))


def edge_runs(c: Column) -> Column:
    """The outer runs of a needle without an inner word, as ``struct(run, side)``.

    The first run must end a run of the text, the last must start one, a single run may stand
    inside one. Runs of word characters are used unless there is none.
    """
    runs = F.regexp_extract_all(c, F.lit(tx.ANY_RUN), F.lit(0))

    def sides(rs: Column) -> Column:
        n = F.size(rs)
        placed = F.transform(
            rs,
            lambda r, i: F.struct(
                r.alias("run"), F.when(n == 1, "inside").when(i == 0, "end").when(i == n - 1, "start").otherwise("whole").alias("side")
            ),
        )
        words = F.filter(placed, lambda p: p["run"].rlike(tx.WORD_RUN))
        return F.when(F.size(words) > 0, words).otherwise(placed)

    return tx.let(runs, sides)


def all_runs(c: Column) -> Column:
    """Distinct runs of word characters and of other characters."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(tx.ANY_RUN), F.lit(0)))


def expand_to_vocabulary(runs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``runs(run, side)`` with every vocabulary ``term`` that has the run at that side.

    Joined on up to three characters of the run: its last ones for ``end``, its first ones for
    ``start`` and ``inside``; for ``inside`` against all pieces of the term of that length.
    """
    size = F.length("term")

    def cut(kind: str, piece: Column) -> Column:
        return F.struct(F.lit(kind).alias("side"), piece.alias("piece"))

    outer = [cut("start", F.left("term", F.lit(g))) for g in (1, 2, 3)]
    outer += [cut("end", F.right("term", F.lit(g))) for g in (1, 2, 3)]
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(size, F.lit(3))),
            lambda g: F.transform(F.sequence(F.lit(1), size - g + 1), lambda i: F.substring("term", i, g)),
        )
    )
    every = F.concat(
        F.array(*outer, cut("whole", F.col("term"))), F.transform(F.array_distinct(grams), lambda g: cut("inside", g))
    )
    terms = vocabulary.filter(size > 0).select("term", F.inline(every))
    n = F.least(F.length("run"), F.lit(3))
    piece = F.when(F.col("side") == "end", F.right(F.col("run"), n)).when(
        F.col("side") == "whole", F.col("run")
    ).otherwise(F.left(F.col("run"), n))
    fits = (
        F.when(F.col("side") == "end", F.endswith("term", F.col("run")))
        .when(F.col("side") == "start", F.startswith("term", F.col("run")))
        .otherwise(F.contains("term", F.col("run")))
    )
    return runs.withColumn("piece", piece).join(terms, ["side", "piece"]).filter(fits).select("run", "side", "term").distinct()


def candidates(anchors: DataFrame, edges: DataFrame, texts: DataFrame, text_id: str, tokens: Column) -> DataFrame:
    """Distinct ``owner, text_id`` pairs that can match.

    ``anchors(owner, needle, term)``: the text must hold all these terms; joined on the rarest.
    ``edges(owner, needle, run, side)``: outer runs of needles without an inner word; the run
    with the fewest expansions is used.
    ``tokens``: array of distinct terms of a text.
    """
    has_edges = not edges.isEmpty()
    postings = texts.select(F.col(text_id), F.explode(tokens).alias("term"))
    needed = anchors.select("term")
    if has_edges:
        asked_runs = edges.select("run", "side").distinct()
        expanded = cut_lineage(expand_to_vocabulary(asked_runs, postings.select("term").distinct()), "edge-terms")
        needed = needed.union(expanded.select("term"))
    needed = broadcast_if_small(needed.distinct())
    found = cut_lineage(postings.join(needed, "term", "left_semi"), "postings")  # of the asked terms only
    freq = found.groupBy("term").agg(F.count("*").alias("df"))

    # A needle with a word the corpus lacks cannot occur: df 0 drops it in the join below.
    wanted_keys = (
        anchors.join(freq, "term", "left")
        .groupBy("owner", "needle")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("best"))
        .select("owner", F.col("best.term").alias("term"))
    )
    if has_edges:
        # A run without any expansion rules its needle out, so it counts as the best one.
        load = expanded.join(freq, "term").groupBy("run", "side").agg(F.sum("df").alias("df"))
        best = edges.distinct().join(load, ["run", "side"], "left").groupBy("owner", "needle").agg(
            F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "run", "side")).alias("b")
        ).select("owner", "needle", "b.run", "b.side")
        wanted_keys = wanted_keys.union(expanded.join(best, ["run", "side"]).select("owner", "term"))
    return salted_join(found, wanted_keys.distinct(), "term", heavy_keys(freq, "term", "df"), F.col(text_id)).select("owner", text_id).distinct()


def containment_join(
    needles: DataFrame, needle_id: str, needle: str, texts: DataFrame, text_id: str, text: str,
) -> DataFrame:
    """All ``needle_id, text_id`` pairs where the text contains the (non-empty) needle."""
    mine = needles.filter(F.length(needle) > 0).select(F.col(needle_id).alias("owner"), F.col(needle).alias("_needle"))
    words = mine.withColumn("w", inner_words(F.col("_needle")))
    anchors = words.filter(F.size("w") > 0).select("owner", F.lit(0).alias("needle"), F.explode("w").alias("term"))
    edges = words.filter(F.size("w") == 0).select("owner", F.lit(0).alias("needle"), F.inline(edge_runs(F.col("_needle"))))
    # Only edges ask for runs of other characters.
    words_only = F.array_distinct(F.regexp_extract_all(text, F.lit(tx.WORD_RUN), F.lit(0)))
    runs = words_only if edges.isEmpty() else all_runs(F.col(text))
    pairs = cut_lineage(candidates(anchors, edges, texts, text_id, runs), "pairs")
    near = keep_ids(texts.select(text_id, F.col(text).alias("_text")), text_id, pairs)
    tested = pairs.join(mine, "owner").join(near, text_id)
    return tested.filter(F.contains("_text", F.col("_needle"))).select(F.col("owner").alias(needle_id), text_id)


def phrase_hits(phrases: DataFrame, phrase_id: str, phrase: str, texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """Texts holding each phrase, ignoring case."""
    low = phrases.select(phrase_id, F.lower(phrase).alias("_phrase"))
    return containment_join(low, phrase_id, "_phrase", texts.select(text_id, F.lower(text).alias("_low")), text_id, "_low")


def _word_hits(words: DataFrame, texts: DataFrame, text_id: str) -> DataFrame:
    """``owner, text_id`` of ``words(owner, _term)`` that are words of ``texts(text_id, _low)``, found where the text lies."""
    if table_bytes(words) > BROADCAST_LIMIT:
        runs = F.array_distinct(F.regexp_extract_all("_low", F.lit(tx.WORD_RUN), F.lit(0)))
        return texts.select(text_id, F.explode(runs).alias("_term")).join(words, "_term").select("owner", text_id)
    asked = words.select("owner", "_term").toArrow().combine_chunks().sort_by("_term")
    terms = asked.column("_term").combine_chunks().dictionary_encode()  # sorted, so numbered in the order of the rows
    names, owners = terms.dictionary, asked.column("owner").combine_chunks()
    first = np.searchsorted(terms.indices.to_numpy(), np.arange(len(names) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_low"):
            sizes, found = split_words(part.column("_low"))
            at = pc.index_in(found, value_set=names).fill_null(-1).to_numpy()
            cells = np.repeat(np.arange(len(sizes)), sizes) * max(len(names), 1) + at
            row, name = np.divmod(np.unique(cells[at >= 0]), max(len(names), 1))
            # A word that several terms ask for counts for each of them.
            each = first[name + 1] - first[name]
            place = np.repeat(first[name] - np.cumsum(each) + each, each) + np.arange(each.sum())
            texts = part.column(text_id).take(pa.array(np.repeat(row, each)))
            yield pa.RecordBatch.from_arrays([owners.take(pa.array(place)), texts], ["owner", text_id])

    kinds = StructType([words.schema["owner"], texts.schema[text_id]])
    return texts.select(text_id, tx.ascii_gaps(F.col("_low")).alias("_low")).mapInArrow(run, kinds)


def term_hits(terms: DataFrame, term_id: str, term: str, texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """Texts holding each term between word boundaries, ignoring case.

    The boundaries make every word of the term a complete word of the text, the outer ones too. So a term of one word
    stands in the texts with this word, and only others are compared with texts.
    """
    low = terms.select(F.col(term_id).alias("owner"), F.lower(term).alias("_term")).filter("_term <> '' and owner is not null")
    body = texts.select(text_id, F.lower(text).alias("_low"))
    one_word = F.regexp_like("_term", F.lit(f"^{tx.WORD_RUN}$"))
    known = body.filter(F.col(text_id).isNotNull() & F.col("_low").isNotNull())
    direct = _word_hits(low.filter(one_word), known, text_id).select(F.col("owner").alias(term_id), text_id)
    low = low.filter(~one_word)
    if low.isEmpty():
        return direct
    words = low.withColumn("w", F.array_distinct(F.regexp_extract_all("_term", F.lit(tx.WORD_RUN), F.lit(0))))
    anchors = words.filter(F.size("w") > 0).select("owner", F.lit(0).alias("needle"), F.explode("w").alias("term"))
    edges = words.filter(F.size("w") == 0).select("owner", F.lit(0).alias("needle"), F.inline(edge_runs(F.col("_term"))))
    pairs = cut_lineage(candidates(anchors, edges, body, text_id, all_runs(F.col("_low"))), "pairs")
    tested = pairs.join(low, "owner").join(keep_ids(body, text_id, pairs), text_id)
    return direct.unionByName(tested.filter(F.regexp_like(F.col("_low"), tx.whole_word_pattern(F.col("_term")))).select(
        F.col("owner").alias(term_id), text_id
    ))
