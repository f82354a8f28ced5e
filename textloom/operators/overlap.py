"""BLEU and ROUGE for a table of pairs ``pair_id, candidate, reference``.

N-grams are counted where the pair lies, as numbers of tokens, and only the counts leave the task. Where an id
names several pairs, their n-grams are exploded with a side tag and counted together by (id, n, n-gram).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from textloom.functions import text as tx
from textloom.functions.arrow import slices, split_blanks
from textloom.functions.stem import porter_stems
from textloom.operators.skew import broadcast_if_small
from textloom.session import cut_lineage


def overlap_tokens(c: Column) -> Column:
    """Lower-case ``[a-z0-9]+`` tokens."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


TOKENIZERS = {"space": tx.split_words, "words": tx.word_runs, "overlap": overlap_tokens}


def _grams(tokens: Column, orders: tuple[int, ...]) -> Column:
    """All n-grams of the given orders as ``struct(n, gram)``."""
    def of(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n))
        grams = F.transform(
            starts,
            lambda i: F.struct(
                F.lit(n).alias("n"), F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]).alias("gram")
            ),
        )
        return F.coalesce(grams, F.array().cast("array<struct<n:int,gram:string>>"))

    return F.concat(*[of(n) for n in orders])


def stemmed(pairs: DataFrame, stems: DataFrame) -> DataFrame:
    """Replace tokens longer than three characters by their stem from ``stems(token, stem)``."""
    def side(col: str) -> DataFrame:
        words = pairs.select("pair_id", F.posexplode(overlap_tokens(F.col(col))).alias("i", "token"))
        got = words.join(stems, "token", "left").withColumn(
            "t", F.when(F.length("token") > 3, F.coalesce("stem", "token")).otherwise(F.col("token"))
        )
        # The tokens of one text: bounded by its length.
        back = got.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("a"))
        return back.select("pair_id", F.array_join(F.transform("a", lambda x: x["t"]), " ").alias(col))

    rest = pairs.drop("candidate", "reference")
    return rest.join(side("candidate"), "pair_id", "left").join(side("reference"), "pair_id", "left").fillna(
        "", ["candidate", "reference"]
    )


def english_stems(pairs: DataFrame) -> DataFrame:
    """``token, stem`` of all tokens of both sides, by suffix stripping; for ``stemmed`` and ``rouge``."""
    both = F.concat(overlap_tokens(F.col("candidate")), overlap_tokens(F.col("reference")))
    return porter_stems(pairs.select(F.explode(both).alias("token")).filter(F.length("token") > 3))


def _counted(part: pa.RecordBatch, orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, int, list[np.ndarray]]]:
    """Rows with an n-gram, the order, and ``clipped, n_candidate, n_reference`` of these rows."""
    (mine, a), (other, b) = split_blanks(part.column("candidate")), split_blanks(part.column("reference"))
    words = pa.concat_arrays([a, b]).dictionary_encode()
    ids, n_words = words.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1)
    rows = len(mine)
    sizes = np.concatenate([mine, other])
    side = np.repeat(np.arange(2 * rows), sizes)
    left = np.cumsum(sizes)[side] - np.arange(len(ids))  # tokens from here to the end of the text
    row, reference = side % max(rows, 1), side >= rows
    grams = row  # the number of the n-gram of one order less that begins at each token, within its row
    for n in range(1, max(orders) + 1):
        at = np.flatnonzero(left >= n)
        found, number = np.unique(grams[at] * n_words + ids[at + n - 1], return_inverse=True)
        if n in orders:
            c = np.bincount(number[~reference[at]], minlength=len(found))
            r = np.bincount(number[reference[at]], minlength=len(found))
            owner = np.zeros(len(found), np.int64)
            owner[number] = row[at]
            clipped = np.bincount(owner, np.minimum(c, r), minlength=rows).astype(np.int64)
            totals = [np.maximum(x - n + 1, 0) for x in (mine, other)]
            some = np.flatnonzero(totals[0] + totals[1])
            yield some, n, [x[some] for x in (clipped, *totals)]
        grams = np.zeros(len(ids), np.int64)
        grams[at] = number


def _single_overlap(pairs: DataFrame, orders: tuple[int, ...], tokenizer: str) -> DataFrame:
    """``gram_overlap`` of pairs whose ids differ."""
    tokens = TOKENIZERS[tokenizer]
    kind = pairs.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "candidate", "reference"):
            for rows, n, counts in _counted(part, orders):
                yield pa.RecordBatch.from_arrays(
                    [part.column("pair_id").take(pa.array(rows)), pa.array(np.full(len(rows), n, np.int32)), *map(pa.array, counts)],
                    ["pair_id", "n", "clipped", "n_candidate", "n_reference"],
                )

    # No token holds a blank.
    sides = [F.coalesce(F.array_join(tokens(F.col(c)), " "), F.lit("")).alias(c) for c in ("candidate", "reference")]
    return pairs.select("pair_id", *sides).mapInArrow(
        run, f"pair_id {kind}, n int, clipped bigint, n_candidate bigint, n_reference bigint"
    )


def _joint_overlap(pairs: DataFrame, orders: tuple[int, ...], tokenizer: str) -> DataFrame:
    """``gram_overlap`` of pairs that share ids: their n-grams count together."""
    tokens = TOKENIZERS[tokenizer]

    def tagged(col: str, mine: int) -> DataFrame:
        texts = pairs.select("pair_id", tokens(F.col(col)).alias("t"))
        return texts.select("pair_id", F.explode(_grams(F.col("t"), orders)).alias("g")).select(
            "pair_id", "g.n", "g.gram", F.lit(mine).alias("c"), F.lit(1 - mine).alias("r")
        )

    counts = (
        tagged("candidate", 1).unionByName(tagged("reference", 0))
        .groupBy("pair_id", "n", "gram").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    )
    return counts.groupBy("pair_id", "n").agg(
        F.sum(F.least("c", "r")).alias("clipped"), F.sum("c").alias("n_candidate"), F.sum("r").alias("n_reference")
    )


def gram_overlap(pairs: DataFrame, orders: tuple[int, ...], tokenizer: str) -> DataFrame:
    """``pair_id, n, clipped, n_candidate, n_reference`` per pair and order with any n-gram."""
    pairs = pairs.filter("pair_id is not null")
    repeated = cut_lineage(pairs.groupBy("pair_id").agg(F.count("*").alias("n")).filter("n > 1").select("pair_id"), "repeated-pairs")
    if repeated.isEmpty():
        return _single_overlap(pairs, orders, tokenizer)
    several = broadcast_if_small(repeated)
    return _single_overlap(pairs.join(several, "pair_id", "left_anti"), orders, tokenizer).unionByName(
        _joint_overlap(pairs.join(several, "pair_id", "left_semi"), orders, tokenizer)
    )


def bleu(pairs: DataFrame, smoothing: bool = False, tokenizer: str = "space") -> DataFrame:
    """``pair_id, bleu``: geometric mean of clipped 1-4-gram precisions with brevity penalty.

    ``smoothing`` replaces a zero numerator by 0.1; without it a missing order gives 0, and so
    does an empty side or no shared word in any case.
    """
    per = gram_overlap(pairs, (1, 2, 3, 4), tokenizer).groupBy("pair_id").agg(
        *[F.max(F.when(F.col("n") == n, F.col("clipped"))).alias(f"k{n}") for n in (1, 2, 3, 4)],
        *[F.max(F.when(F.col("n") == n, F.col("n_candidate"))).alias(f"c{n}") for n in (1, 2, 3, 4)],
        F.max(F.when(F.col("n") == 1, F.col("n_reference"))).alias("ref"),
    )
    logs = F.lit(0.0)
    for n in (1, 2, 3, 4):
        hit = F.coalesce(F.col(f"k{n}"), F.lit(0))
        size = F.greatest(F.coalesce(F.col(f"c{n}"), F.lit(0)), F.lit(1))
        low = F.lit(0.1) / size if smoothing else F.lit(0.0)
        logs = logs + F.log(F.when(hit > 0, hit / size).otherwise(low))
    none = F.coalesce(F.col("k1"), F.lit(0)) == 0
    brevity = F.when(F.col("c1") > F.col("ref"), F.lit(1.0)).otherwise(F.exp(1 - F.col("ref") / F.col("c1")))
    score = F.when(none, F.lit(0.0)).otherwise(F.coalesce(brevity * F.exp(logs / 4), F.lit(0.0)))
    return pairs.select("pair_id").join(per.select("pair_id", score.alias("bleu")), "pair_id", "left").fillna(0.0, ["bleu"])


def _f1(hit: Column, a: Column, b: Column) -> Column:
    p, r = hit / a, hit / b
    return F.coalesce(F.when(hit > 0, 2 * p * r / (p + r)), F.lit(0.0))


def rouge(pairs: DataFrame, orders: tuple[int, ...] = (1, 2), stems: DataFrame | None = None) -> DataFrame:
    """``pair_id, rouge1, rouge2``: F1 of the clipped n-gram overlap."""
    if stems is not None:
        pairs = stemmed(pairs, stems)
    per = gram_overlap(pairs, orders, "overlap").groupBy("pair_id").agg(
        *[
            F.max(F.when(F.col("n") == n, _f1(F.col("clipped"), F.col("n_candidate"), F.col("n_reference")))).alias(f"rouge{n}")
            for n in orders
        ]
    )
    names = [f"rouge{n}" for n in orders]
    return pairs.select("pair_id").join(per, "pair_id", "left").fillna(0.0, names)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, 64 cells of the table per machine word."""
    if len(a) < len(b):
        a, b = b, a
    place: dict[str, int] = {}
    for i, t in enumerate(b):
        place[t] = place.get(t, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for t in a:
        match = row & place.get(t, 0)
        row = ((row + match) | (row - match)) & full
    return len(b) - row.bit_count()


@pandas_udf(IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


def rouge_l(pairs: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """``pair_id, rouge_l``: F1 of the longest common subsequence."""
    if stems is not None:
        pairs = stemmed(pairs, stems)
    toks = pairs.select(
        "pair_id", overlap_tokens(F.coalesce("candidate", F.lit(""))).alias("a"),
        overlap_tokens(F.coalesce("reference", F.lit(""))).alias("b"),
    )
    return toks.select("pair_id", _f1(_lcs("a", "b"), F.size("a"), F.size("b")).alias("rouge_l"))


def all_scores(pairs: DataFrame, smoothing: bool, tokenizer: str, stems: DataFrame | None = None) -> DataFrame:
    """BLEU, ROUGE-1, ROUGE-2 and ROUGE-L per pair. The pairs are stored once, as every score reads them."""
    pairs = cut_lineage(pairs, "pairs")
    return (
        pairs.select(*[c for c in pairs.columns if c not in ("candidate", "reference")])
        .join(bleu(pairs, smoothing, tokenizer), "pair_id")
        .join(rouge(pairs, (1, 2), stems), "pair_id")
        .join(rouge_l(pairs, stems), "pair_id")
    )


def compare_reference_sets(pairs: DataFrame, scores: DataFrame | None = None, sets: tuple[str, str] = ("retrieved", "ideal")) -> DataFrame:
    """Best and mean score per query against two sets of references, and the ROUGE-1 ratio.

    ``pairs``: pair_id, query_id, ref_set, candidate, reference.
    """
    rows = all_scores(pairs, True, "words") if scores is None else scores
    names = [c for c in ("bleu", "rouge1", "rouge2", "rouge_l") if c in rows.columns]
    aggs = []
    for s in sets:
        for n in names:
            mine = F.when(F.col("ref_set") == s, F.col(n))
            aggs.append(F.round(F.max(mine), 4).alias(f"{n}_max_{s}"))
            aggs.append(F.round(F.avg(mine), 4).alias(f"{n}_avg_{s}"))
    per = rows.groupBy("query_id").agg(*aggs)
    a, b = F.coalesce(f"rouge1_avg_{sets[0]}", F.lit(0.0)), F.coalesce(f"rouge1_avg_{sets[1]}", F.lit(0.0))
    return per.withColumn("rouge1_ratio", F.when(b > 0, F.round(a / F.when(b > 0, b), 3)))


def answer_evaluation(answers: DataFrame, ranked: DataFrame, n: int = 3, stems: DataFrame | None = None) -> DataFrame:
    """Score each answer against its first ``n`` documents and against their concatenation.

    ``answers``: query_id, answer; ``ranked``: query_id, rank, chunk_id, key_quote. Rank 0 is
    the concatenation.
    """
    top = ranked.filter(F.col("rank") <= n).select("query_id", F.col("rank").cast("long"), "chunk_id", F.col("key_quote").alias("reference"))
    joined = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "reference"))).alias("m")).select(
        "query_id", F.lit(0).cast("long").alias("rank"), F.lit(None).cast("long").alias("chunk_id"),
        F.array_join(F.transform("m", lambda x: x["reference"]), " ").alias("reference"),
    )
    pairs = top.unionByName(joined).join(answers, "query_id").withColumnRenamed("answer", "candidate")
    pairs = pairs.withColumn("pair_id", F.concat_ws(":", "query_id", "rank")).withColumn(
        "reference_length", F.length("reference").cast("long")
    ).withColumn("answer_length", F.length("candidate").cast("long"))
    return all_scores(pairs, False, "space", stems).drop("rouge2")
