"""Analytics over repeated evaluation runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

DIMENSIONS = ["FA", "CA", "HD", "EC"]
# Column names of a run file and the short names used here.
RENAMES = {
    "Query": "QueryText", "RubricFactualAccuracy": "FA", "RubricCitationAccuracy": "CA",
    "RubricHistoriographicalDepth": "HD", "RubricEpistemicCalibration": "EC", "RecallAt5": "R@5",
    "RetrievalKeywordCountTop5": "KW", "RetrievalSemanticCountTop5": "Sem",
}
# Answer length expected per synthesis type.
MIN_WORDS = {"T1": 50, "T2": 100, "T3": 150, "T4": 200, "T5": 300}


def normalize_run(df: DataFrame, run: int | None = None) -> DataFrame:
    """Short column names; score spread and rubric total are filled in when absent."""
    df = df.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in df.columns})
    if run is not None:
        df = df.withColumn("run", F.lit(run))
    if "Rerank" not in df.columns:
        both = {"RerankerScoreMaxTop5", "RerankerScoreMinTop5"} <= set(df.columns)
        spread = F.col("RerankerScoreMaxTop5") - F.col("RerankerScoreMinTop5") if both else F.lit(None).cast("double")
        df = df.withColumn("Rerank", spread)
    if "RubricTotal" not in df.columns and set(DIMENSIONS) <= set(df.columns):
        df = df.withColumn("RubricTotal", null_skipping_sum([F.col(d) for d in DIMENSIONS]))
    return df


def null_skipping_sum(cols: list[Column]) -> Column:
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(c, F.lit(0.0))
    return total


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def category_summary(results: DataFrame) -> DataFrame:
    """Per category: N, mean precision and recall (missing counts as 0), mean rubric (missing skipped)."""
    return results.groupBy("category").agg(
        F.count("*").alias("n"), F.avg(F.coalesce("precision", F.lit(0.0))).alias("avg_precision"),
        F.avg(F.coalesce("recall", F.lit(0.0))).alias("avg_recall"), F.avg("rubric_total").alias("avg_rubric"),
    )


def run_summary(runs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and sample standard deviation of each value over the runs of a query."""
    aggs = [F.count("*").alias("n_runs")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd")]
    return runs.groupBy(*keys).agg(*aggs)


def grand_means(runs: DataFrame, values: list[str]) -> DataFrame:
    return runs.agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])


def _poisson_weights(ids: np.ndarray, seed: int, resamples: int) -> np.ndarray:
    """Poisson(1) weight per observation and replicate, a function of id and seed alone."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = x + (np.arange(1, resamples + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(0xD1B54A32D192ED03)
        # Finaliser of the SplitMix64 generator (public domain constants).
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    u = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    steps = np.cumsum(np.exp(-1.0) / np.concatenate([[1.0], np.cumprod(np.arange(1.0, 15.0))]))
    return np.searchsorted(steps, u, side="right").astype(np.float64)


def bootstrap_replicates(obs: DataFrame, obs_id: str, value: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Mean of each bootstrap replicate.

    Each task adds up weighted values for all replicates and sends one row per replicate, so
    the shuffle does not grow with the observations. Weights depend on the observation id only.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            ids = batch.column("i").to_numpy()
            vals = batch.column("v").to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), 2048):
                w = _poisson_weights(ids[at:at + 2048], seed, resamples)
                weight += w.sum(axis=0)
                total += vals[at:at + 2048] @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(resamples)), pa.array(weight), pa.array(total)], names=["replicate", "w", "t"]
        )

    rows = obs.filter(F.col(value).isNotNull()).select(F.col(obs_id).cast("long").alias("i"), F.col(value).cast("double").alias("v"))
    part = rows.mapInArrow(scan, "replicate long, w double, t double")
    return part.groupBy("replicate").agg((F.sum("t") / F.sum("w")).alias("mean"))


def bootstrap_interval(obs: DataFrame, obs_id: str, value: str, level: float = 0.95, **kw) -> DataFrame:
    """Grand mean with the percentile interval of its bootstrap replicates."""
    tail = (1 - level) / 2
    reps = bootstrap_replicates(obs, obs_id, value, **kw)
    return reps.agg(
        F.count("*").alias("n_replicates"), F.percentile("mean", F.lit(tail)).alias("ci_low"),
        F.percentile("mean", F.lit(1 - tail)).alias("ci_high"),
    ).withColumn("mean", obs.select(F.avg(value)).scalar())


def run_means(runs: DataFrame, values: list[str], total: str) -> DataFrame:
    per = runs.groupBy("run").agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])
    spread = per.select(F.max(total) - F.min(total)).scalar()
    return per.withColumn("total_spread", spread)


def run_matrix(runs: DataFrame, key: str, value: str, run_ids: list[int]) -> DataFrame:
    """One row per query, one column per run, and the mean over runs (order by it to display)."""
    cells = [F.avg(F.when(F.col("run") == r, F.col(value))).alias(f"run_{r}") for r in run_ids]
    return runs.groupBy(key).agg(*cells, F.avg(value).alias("mean"))


def flat_reranker(spread: Column, recall: Column) -> Column:
    return (spread < 0.05) & (recall < 0.30)


def type_direction(got: Column, expected: Column) -> Column:
    """Compare ordinal types ``T1``-``T5``."""
    diff = F.substring(got, 2, 9).cast("int") - F.substring(expected, 2, 9).cast("int")
    return F.when(diff == 0, "correct").when(diff > 0, "upgrade").when(diff < 0, "downgrade")


def direction_summary(obs: DataFrame) -> DataFrame:
    d = type_direction(F.col("got"), F.col("expected"))
    return obs.withColumn("direction", d).filter("direction is not null").groupBy("direction").agg(
        F.count("*").alias("n"), F.avg("total").alias("mean_total"), F.avg("HD").alias("mean_hd")
    )


def type_accuracy(obs: DataFrame) -> DataFrame:
    return obs.groupBy("expected").agg(
        F.count("*").alias("n"), F.avg(F.coalesce(F.col("got") == F.col("expected"), F.lit(False)).cast("double")).alias("accuracy")
    )


def outcome_totals(obs: DataFrame, counts: list[str], fabricated: str) -> DataFrame:
    return obs.agg(
        F.count("*").alias("n_observations"), *[F.sum(c).cast("long").alias(c) for c in counts],
        (F.sum(fabricated) / F.count("*")).alias("fabrication_rate"),
    )


def human_vs_automatic(human: DataFrame, auto: DataFrame, key: str) -> DataFrame:
    """Scores of both sides per id with the differences; totals to 2 digits."""
    h = human.select(key, *[F.coalesce(d, F.lit(0.0)).alias(f"human_{d}") for d in DIMENSIONS])
    a = auto.select(key, *[F.coalesce(d, F.lit(0.0)).alias(f"auto_{d}") for d in DIMENSIONS])
    both = h.join(a, key)
    for side in ("human", "auto"):
        both = both.withColumn(f"{side}_total", F.round(null_skipping_sum([F.col(f"{side}_{d}") for d in DIMENSIONS]), 2))
    for d in DIMENSIONS:
        both = both.withColumn(f"delta_{d}", F.col(f"human_{d}") - F.col(f"auto_{d}"))
    return both.withColumn("delta", F.round(F.col("human_total") - F.col("auto_total"), 2))


def correction_summary(compared: DataFrame, threshold: float = 0.24) -> DataFrame:
    return compared.agg(
        F.count("*").alias("n"), F.avg((F.abs("delta") > threshold).cast("double")).alias("correction_rate"),
        F.avg("delta").alias("mean_delta"), *[F.avg(f"delta_{d}").alias(f"mean_delta_{d}") for d in DIMENSIONS],
    )


def quadrants(per_query: DataFrame) -> DataFrame:
    """Place each query against the grand means of HD and EC."""
    hd = F.col("HD") >= per_query.select(F.avg("HD")).scalar()
    ec = F.col("EC") >= per_query.select(F.avg("EC")).scalar()
    side = F.concat(F.when(hd, "high_HD").otherwise("low_HD"), F.lit("/"), F.when(ec, "high_EC").otherwise("low_EC"))
    return per_query.withColumn("quadrant", side)


def pending(queries: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return queries.join(results.select(key), key, "left_anti")


def compare_configs(results: DataFrame, key: str, config: str, values: list[str], a: str, b: str) -> DataFrame:
    """The same queries under two configurations side by side, for queries run under both."""
    cells = []
    for v in values:
        cells += [F.max(F.when(F.col(config) == a, F.col(v))).alias(f"{v}_a"), F.max(F.when(F.col(config) == b, F.col(v))).alias(f"{v}_b")]
    per = results.groupBy(key).agg(
        *cells, F.count_if(F.col(config) == a).alias("_na"), F.count_if(F.col(config) == b).alias("_nb")
    ).filter("_na > 0 and _nb > 0").drop("_na", "_nb")
    for v in values:
        per = per.withColumn(f"{v}_diff", F.col(f"{v}_b") - F.col(f"{v}_a"))
    return per


def compare_all_configs(results: DataFrame, key: str, config: str, values: list[str]) -> DataFrame:
    """Every pair of configurations that a query was run under, side by side, the lesser name as ``config_a``.

    The results of one query come together in one row of its configurations, which are few, and each
    pair is made there, so the table is shuffled once. Of repeated results the largest values count.
    """
    per = results.groupBy(key, config).agg(*[F.max(v).alias(v) for v in values])
    listed = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(config).alias("config"), *values))).alias("_all"))
    first = listed.select(key, "_all", F.posexplode("_all").alias("_at", "_a"))
    pairs = first.select(key, "_a", F.explode(F.slice("_all", F.col("_at") + 2, F.size("_all"))).alias("_b"))
    sides = [F.col(f"_{side}.{v}").alias(f"{v}_{side}") for v in ("config", *values) for side in "ab"]
    return pairs.select(key, *sides, *[(F.col(f"_b.{v}") - F.col(f"_a.{v}")).alias(f"{v}_diff") for v in values])


def spread_band(spread: Column) -> Column:
    return F.when(spread >= 0.20, "differentiated").when(spread < 0.10, "flat").otherwise("moderate")


def rubric_band(total: Column) -> Column:
    return F.when(total >= 3.0, "pass").when(total >= 2.0, "warn").otherwise("fail")


def grounding_band(rouge1: Column, synthesis: Column) -> Column:
    direct = F.when(rouge1 >= 0.45, "close").when(rouge1 < 0.25, "low").otherwise("moderate")
    return F.when(synthesis.isin(1, 2), direct).when(synthesis == 3, "partial expected").otherwise(
        F.when(rouge1 >= 0.30, "good").otherwise("low")
    )


def ratio_band(ratio: Column) -> Column:
    return F.when(ratio.between(0.7, 1.3), "normal").when(ratio > 1.3, "retrieved_heavy").when(ratio < 0.7, "ideal_heavy")


def metric_band(value: Column, good: float) -> Column:
    v = F.coalesce(value, F.lit(0.0))
    return F.when(v >= good, "pass").when(v > 0, "warn").otherwise("fail")


def length_band(words: Column, expected: Column) -> Column:
    least = F.lit(0)
    for t, n in MIN_WORDS.items():
        least = F.when(expected == t, n).otherwise(least)
    return F.when(words >= least, "pass").otherwise("warn")


def result_table(results: DataFrame) -> DataFrame:
    """Per-query report: flags as marks, metrics to 2 digits."""
    def mark(c: str) -> Column:
        return F.when(F.col(c).isNull(), "?").when(F.col(c), "yes").otherwise("no")

    counts = [c for c in results.columns if c.startswith("n_")]
    return results.select(
        "query_id", F.left("category", F.lit(20)).alias("category"), mark("task_correct").alias("task"),
        mark("synthesis_correct").alias("synthesis"),
        *[F.round(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in ("precision", "recall", "ceiling_precision")],
        *counts, "rubric_total",
    )


def in_groups(queries: DataFrame, group: str, selected: list[str]) -> DataFrame:
    return queries.filter(F.col(group).isin(selected))


def browse(runs: DataFrame, category: str | None = None, query: object = None, run: int | None = None) -> DataFrame:
    """Rows of one category, one query or one run; None means all."""
    for col, value in (("category", category), ("query_id", query), ("run", run)):
        if value is not None:
            runs = runs.filter(F.col(col) == value)
    return runs
