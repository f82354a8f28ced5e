"""Queries over the given tables, one for each operator, with DuckDB statements where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import (
    ann, exact_dedup, near_dedup, packing, periodic_runs, pii, sentencepieces, sharding, spelling, substring_dedup, token_counts,
    tokens, toxicity,
)
from textloom.llm.common import UPPER, new_folder, store, whole

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 8
SEQUENCE = 4096


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_exact_dedup", f"""
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
        sha256(norm) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents)
    WINDOW g AS (PARTITION BY norm)
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"), keep="largest")


_DIGEST = "('0x' || substring(md5({}), 1, 15))::BIGINT"

# DuckDB has no CRC-32, so the statement leaves text_crc32 to the brute-force test.
OP2_SQL = f"""
    WITH keyed AS (
        SELECT doc_id, (coalesce(strlen(text), 0) + 1)::BIGINT AS size, {_DIGEST.format("coalesce(text, '')")} AS a,
            {_DIGEST.format("coalesce(doc_id::VARCHAR, '')")} AS b
        FROM documents
    ), totals AS (
        SELECT *, (CASE WHEN x = 0 THEN 0 ELSE floor(log2(x)) + 1 END)::BIGINT AS bits
        FROM (SELECT sum(size)::BIGINT AS total, (greatest(sum(size) - 1, 0) // {sharding.CELL_BYTES})::BIGINT AS x FROM keyed)
    ), units AS (
        SELECT a, b, sum(n) OVER (ORDER BY a, b) - n AS lo, sum(n) OVER (ORDER BY a, b) AS hi,
            sum(n) OVER (ORDER BY a) - sum(n) OVER (PARTITION BY a) AS glo, sum(n) OVER (ORDER BY a) AS ghi
        FROM (SELECT a, b, sum(size)::BIGINT AS n FROM keyed GROUP BY a, b)
    ), marks AS (
        SELECT i, total, arg_min(struct_pack(a := u.a, b := u.b), (hi::HUGEINT, u.a, u.b)) AS pos
        FROM range(1, {SHARDS}) AS r(i), totals, units AS u WHERE {SHARDS} * hi >= i * total GROUP BY i, total
    ), held AS (
        SELECT i, total, u.*,
            CASE WHEN abs({SHARDS} * glo - i * total) <= abs({SHARDS} * ghi - i * total) THEN glo ELSE ghi END AS gedge,
            CASE WHEN abs({SHARDS} * lo - i * total) <= abs({SHARDS} * hi - i * total) THEN lo ELSE hi END AS edge
        FROM marks JOIN units AS u ON u.a = pos.a AND u.b = pos.b
    ), bounds AS (
        SELECT i, CASE WHEN abs({SHARDS} * gedge - i * total) * {sharding.SNAP} <= total THEN gedge ELSE edge END AS pos FROM held
    ), hot AS (
        SELECT a FROM keyed, totals GROUP BY a, total HAVING count(*) > 1 AND sum(size) * {sharding.HOT_PARTS} >= total
    ), placed AS (
        SELECT k.doc_id, k.size, k.a, k.b, (SELECT count(*) FROM bounds WHERE bounds.pos <= u.lo)::INTEGER AS shard,
            k.a // (1::BIGINT << (60 - bits)) AS cell,
            CASE WHEN k.a IN (SELECT a FROM hot) THEN 1 + k.b // (1::BIGINT << (60 - bits)) ELSE 0 END AS part
        FROM keyed AS k JOIN units AS u ON u.a = k.a AND u.b = k.b, totals
    )
    SELECT doc_id, size, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY cell, part, a, b) - 1 AS slot,
        NULL::INTEGER AS grown_shard
    FROM placed
"""


@query("op2_histogram_sharding")
def op2_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", F.crc32(whole("text").cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=50)
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokens.read_tokens(spark, path, with_crc=True).select(
        "doc_id", F.col("start").cast("long"), F.col("n_tokens").cast("long"), "ids_crc32"
    )


@query("op5_posting_lists")
def op5_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5)


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, SEQUENCE, with_tokens=False,
    )
    return packing.pack(cut, SEQUENCE)


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(pii.sample_texts(docs)))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentencepieces.encode(table(spark, sf_dir, "documents"), model)
    return sentencepieces.decode(encoded, model).select(
        "doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256")
    )


def held_out(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(*toxicity.fitting_sample(docs, labels, "toxic", ~held_out("doc_id")))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"), "offending",
    )


@query("op10_minhash_near_dedup")
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > SEQUENCE)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where one document of ten by its checksum repeats some words of its own to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    g = F.floor(h / 10)
    cut = F.filter(F.split(whole("text"), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    worded = docs.select("doc_id", "text", g.alias("_g"), F.when(chosen, cut).alias("_w"))
    counted = worded.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, (F.col("_g") % F.col("_n")).cast("int")))
    left = F.col("_n") - F.col("_a")
    period = (1 + F.floor(left / (3 + F.col("_g") % 8))).cast("int")
    block = F.slice("_w", F.col("_a") + 1, period)
    turns = F.ceil(left / period).cast("int")
    longer = F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(F.flatten(F.array_repeat(block, turns)), F.lit(1), left))
    return counted.select("doc_id", F.when(F.col("_n") > 0, F.concat_ws(" ", longer)).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # a is better than b if length / period is greater as a fraction; runs come by start, then period
    better = lambda a, b: F.when(a["length"] * b["period"] >= b["length"] * a["period"], a).otherwise(b)
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), better)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("_b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_b.start", "_b.length", "_b.period",
        F.floor(1000 * F.col("_b.length") / F.col("_b.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def drop_letter(doc_id: object, word: str) -> str:
    """One occurrence of 31 by the checksum of identifier and word loses a letter. Without an identifier none does."""
    h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{word}".encode())
    return word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = store(spelling.vocabulary(docs, "a-zA-Z\u00C0-\u00FF", 7, 2, drop_letter), "words")
    return spelling.variants(words, factor=10)
