"""Registered queries: analytics over evaluation runs.

Events stand for runs: the user is the query, the day of the month the run, and the scaled mean
values of clicks, views, purchases and signups are the four rubric dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.operators import evals
from textloom.operators.quotes import outcome_counts
from textloom.plans.quote_queries import SQL_VERIFIED, verified
from textloom.plans.registry import query, r6, table

DIMS = {"FA": "click", "CA": "view", "HD": "purchase", "EC": "signup"}
DAYS = list(range(1, 32))  # every day a month can have

SQL_RUNS = f"""
runs AS (SELECT user_id AS query_id, 'category ' || (user_id % 5) AS category, CAST(day(ts) AS BIGINT) AS run,
  {', '.join(f"avg(least(value, 100) / 100) FILTER (event_type = '{e}') AS {k}" for k, e in DIMS.items())},
  count(*) FILTER (event_type = 'purchase') / count(*) AS precision, count(*) FILTER (event_type = 'click') / count(*) AS recall,
  max(value) AS hi, min(value) AS lo, count(*) AS n_events FROM events GROUP BY ALL),
tot AS (SELECT *, {' + '.join(f'coalesce({k}, 0)' for k in DIMS)} AS total, CASE WHEN {' AND '.join(f'{k} IS NULL' for k in DIMS)} THEN NULL ELSE {' + '.join(f'coalesce({k}, 0)' for k in DIMS)} END AS rubric FROM runs)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("run", F.dayofmonth("ts").cast("long"))
    score = F.least("value", F.lit(100)) / 100
    per = ev.groupBy("user_id", "run").agg(
        *[F.avg(F.when(F.col("event_type") == e, score)).alias(k) for k, e in DIMS.items()],
        (F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("precision"),
        (F.count_if(F.col("event_type") == "click") / F.count("*")).alias("recall"),
        F.max("value").alias("hi"), F.min("value").alias("lo"), F.count("*").alias("n_events"),
    )
    dims = [F.col(k) for k in DIMS]
    total = evals.null_skipping_sum(dims)
    category = F.concat(F.lit("category "), F.col("user_id") % 5)
    return (
        per.withColumn("category", category).withColumnRenamed("user_id", "query_id").withColumn("total", total)
        .withColumn("rubric", F.when(F.coalesce(*dims).isNotNull(), total))
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Means rounded for comparison; a nudge keeps sums of another order from splitting exact halves."""
    return df.select(*[
        F.round(F.col(f.name) + 1e-9, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields
    ])


@query("e1_category_summary", f"""WITH {SQL_RUNS}
SELECT category, count(*) AS n, round(avg(precision) + 1e-9, 6) AS avg_precision, round(avg(recall) + 1e-9, 6) AS avg_recall, round(avg(rubric) + 1e-9, 6) AS avg_rubric FROM tot GROUP BY category""")
def e1(spark, d):
    return rounded(evals.category_summary(runs(spark, d).withColumn("rubric_total", F.col("rubric"))))


@query("e2_run_normalisation", f"""WITH {SQL_RUNS}
SELECT query_id, run, round(FA + 1e-9, 6) AS FA, round(CA + 1e-9, 6) AS CA, round(HD + 1e-9, 6) AS HD, round(EC + 1e-9, 6) AS EC, round(hi - lo + 1e-9, 6) AS Rerank, round(total + 1e-9, 6) AS RubricTotal FROM tot""")
def e2(spark, d):
    raw = runs(spark, d).select(
        "query_id", "run", F.col("FA").alias("RubricFactualAccuracy"), F.col("CA").alias("RubricCitationAccuracy"),
        F.col("HD").alias("RubricHistoriographicalDepth"), F.col("EC").alias("RubricEpistemicCalibration"),
        F.col("hi").alias("RerankerScoreMaxTop5"), F.col("lo").alias("RerankerScoreMinTop5"),
    )
    need = ["FA", "CA", "HD", "EC", "Rerank", "RubricTotal"]
    out = evals.require_columns(evals.normalize_run(raw), need)
    return rounded(out.select("query_id", "run", *need))


@query("e3_mean_and_sd", f"""WITH {SQL_RUNS}
SELECT query_id, category, count(*) AS n_runs, {', '.join(f'round(avg({v}) + 1e-9, 6) AS {v}_mean, round(stddev_samp({v}) + 1e-9, 6) AS {v}_sd' for v in ('total', 'recall', 'FA'))} FROM tot GROUP BY ALL""")
def e3(spark, d):
    return rounded(evals.run_summary(runs(spark, d), ["query_id", "category"], ["total", "recall", "FA"]))


@query("e4_grand_means", f"""WITH {SQL_RUNS}
SELECT count(*) AS n, {', '.join(f'round(avg({v}) + 1e-9, 6) AS {v}' for v in ('total', 'FA', 'CA', 'HD', 'EC'))} FROM tot""")
def e4_means(spark, d):
    return rounded(evals.grand_means(runs(spark, d), ["total", "FA", "CA", "HD", "EC"]))


@query("e4_bootstrap_interval")
def e4(spark, d):
    return rounded(evals.bootstrap_interval(table(spark, d, "events"), "event_id", "value"))


@query("e5_run_means", f"""WITH {SQL_RUNS},
p AS (SELECT run, count(*) AS n, avg(FA) AS FA, avg(total) AS total FROM tot GROUP BY run)
SELECT run, n, round(FA + 1e-9, 6) AS FA, round(total + 1e-9, 6) AS total, round((SELECT max(total) - min(total) FROM p) + 1e-9, 6) AS total_spread FROM p""")
def e5(spark, d):
    return rounded(evals.run_means(runs(spark, d), ["FA", "total"], "total"))


@query("e6_query_run_matrix", f"""WITH {SQL_RUNS}
SELECT query_id, {', '.join(f'round(avg(total) FILTER (run = {r}) + 1e-9, 6) AS run_{r}' for r in DAYS)}, round(avg(total) + 1e-9, 6) AS mean FROM tot GROUP BY query_id""")
def e6(spark, d):
    return rounded(evals.run_matrix(runs(spark, d), "query_id", "total", DAYS))


@query("e7_flat_reranker", f"""WITH {SQL_RUNS}
SELECT query_id, run, round(hi - lo, 6) AS spread, hi - lo < 0.05 AND recall < 0.30 AS flat FROM runs""")
def e7(spark, d):
    spread = F.col("hi") - F.col("lo")
    return runs(spark, d).select("query_id", "run", r6(spread).alias("spread"), evals.flat_reranker(spread, F.col("recall")).alias("flat"))


SQL_TYPES = f"""{SQL_RUNS},
ty AS (SELECT *, 'T' || (query_id % 5 + 1) AS expected, CASE WHEN n_events % 7 = 0 THEN NULL ELSE 'T' || (n_events % 5 + 1) END AS got FROM tot)"""


def typed(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_events")
    return runs(spark, d).withColumn("expected", F.concat(F.lit("T"), F.col("query_id") % 5 + 1)).withColumn(
        "got", F.when(n % 7 != 0, F.concat(F.lit("T"), n % 5 + 1))
    )


@query("e8_type_direction", f"""WITH {SQL_TYPES}
SELECT CASE WHEN got = expected THEN 'correct' WHEN got > expected THEN 'upgrade' ELSE 'downgrade' END AS direction, count(*) AS n,
       round(avg(total) + 1e-9, 6) AS mean_total, round(avg(HD) + 1e-9, 6) AS mean_hd FROM ty WHERE got IS NOT NULL GROUP BY 1""")
def e8(spark, d):
    return rounded(evals.direction_summary(typed(spark, d)))


@query("e8_type_accuracy", f"""WITH {SQL_TYPES}
SELECT expected, count(*) AS n, round(avg(CASE WHEN got = expected THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS accuracy FROM ty GROUP BY expected""")
def e8_accuracy(spark, d):
    return rounded(evals.type_accuracy(typed(spark, d)))


@query("e9_outcome_totals", f"""WITH {SQL_VERIFIED},
o AS (SELECT cited % 50 AS query_id, count(*) FILTER (outcome = 'verified') AS n_verified, count(*) FILTER (outcome = 'fabrication') AS n_fabrication FROM verified GROUP BY 1)
SELECT count(*) AS n_observations, CAST(sum(n_verified) AS BIGINT) AS n_verified, CAST(sum(n_fabrication) AS BIGINT) AS n_fabrication, round(sum(n_fabrication) / count(*) + 1e-9, 6) AS fabrication_rate FROM o""")
def e9(spark, d):
    counts = outcome_counts(verified(spark, d).withColumn("query_id", F.col("cited") % 50), "query_id")
    return rounded(evals.outcome_totals(counts, ["n_verified", "n_fabrication"], "n_fabrication"))


SQL_HUMAN = f"""{SQL_RUNS},
per AS (SELECT query_id, avg(FA) AS FA, avg(CA) AS CA, avg(HD) AS HD, avg(EC) AS EC FROM runs GROUP BY query_id),
l AS (SELECT doc_id AS query_id, CAST(quality * 0.25 AS DOUBLE) AS FA, CAST(toxic * 0.5 AS DOUBLE) AS CA, CAST(0.5 AS DOUBLE) AS HD, CAST(0.25 AS DOUBLE) AS EC FROM labels),
cmp AS (SELECT query_id, l.FA - coalesce(per.FA, 0) AS delta_FA, l.CA - coalesce(per.CA, 0) AS delta_CA,
   round(l.FA + l.CA + l.HD + l.EC, 2) AS human_total, round(coalesce(per.FA, 0) + coalesce(per.CA, 0) + coalesce(per.HD, 0) + coalesce(per.EC, 0), 2) AS auto_total
   FROM l JOIN per USING (query_id))"""


def compared(spark: SparkSession, d: str) -> DataFrame:
    auto = runs(spark, d).groupBy("query_id").agg(*[F.avg(k).alias(k) for k in DIMS])
    human = table(spark, d, "labels").select(
        F.col("doc_id").alias("query_id"), (F.col("quality") * 0.25).alias("FA"), (F.col("toxic") * 0.5).alias("CA"),
        F.lit(0.5).alias("HD"), F.lit(0.25).alias("EC"),
    )
    return evals.human_vs_automatic(human, auto, "query_id")


@query("e10_human_comparison", f"""WITH {SQL_HUMAN}
SELECT query_id, round(delta_FA + 1e-9, 6) AS delta_FA, round(delta_CA + 1e-9, 6) AS delta_CA, CAST(human_total AS DOUBLE) AS human_total, auto_total, round(human_total - auto_total, 2) AS delta FROM cmp""")
def e10(spark, d):
    return rounded(compared(spark, d).select("query_id", "delta_FA", "delta_CA", "human_total", "auto_total", "delta"))


@query("e10_correction_rate", f"""WITH {SQL_HUMAN}
SELECT count(*) AS n, round(avg(CASE WHEN abs(round(human_total - auto_total, 2)) > 0.24 THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS correction_rate,
       round(avg(round(human_total - auto_total, 2)) + 1e-9, 6) AS mean_delta, round(avg(delta_FA) + 1e-9, 6) AS mean_delta_FA FROM cmp""")
def e10_rate(spark, d):
    return rounded(evals.correction_summary(compared(spark, d)).select("n", "correction_rate", "mean_delta", "mean_delta_FA"))


@query("e11_browse_filters", f"""WITH {SQL_RUNS}
SELECT query_id, run, round(total + 1e-9, 6) AS total FROM tot WHERE category = 'category 2' AND run = 3""")
def e11(spark, d):
    return rounded(evals.browse(runs(spark, d), category="category 2", run=3).select("query_id", "run", "total"))


@query("e12_quadrants", f"""WITH {SQL_RUNS}, per AS (SELECT query_id, round(avg(HD), 9) AS HD, round(avg(EC), 9) AS EC FROM runs GROUP BY query_id)
SELECT query_id, CASE WHEN HD >= (SELECT avg(HD) FROM per) THEN 'high_HD' ELSE 'low_HD' END || '/' || CASE WHEN EC >= (SELECT avg(EC) FROM per) THEN 'high_EC' ELSE 'low_EC' END AS quadrant FROM per""")
def e12(spark, d):
    per = runs(spark, d).groupBy("query_id").agg(F.round(F.avg("HD"), 9).alias("HD"), F.round(F.avg("EC"), 9).alias("EC"))
    return evals.quadrants(per).select("query_id", "quadrant")


@query("e13_pending_set", """
SELECT c_custkey AS query_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')""")
def e13(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    done = table(spark, d, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("query_id"))
    return evals.pending(asked, done, "query_id")


@query("e14_config_comparison", f"""WITH {SQL_RUNS},
g AS (SELECT a.query_id, 'config ' || a.run AS config_a, 'config ' || b.run AS config_b, a.total AS total_a, b.total AS total_b, a.recall AS recall_a, b.recall AS recall_b
      FROM tot a JOIN tot b ON a.query_id = b.query_id AND 'config ' || a.run < 'config ' || b.run)
SELECT query_id, config_a, config_b, round(total_a + 1e-9, 6) AS total_a, round(total_b + 1e-9, 6) AS total_b, round(recall_a + 1e-9, 6) AS recall_a, round(recall_b + 1e-9, 6) AS recall_b,
       round(total_b - total_a + 1e-9, 6) AS total_diff, round(recall_b - recall_a + 1e-9, 6) AS recall_diff FROM g""")
def e14(spark, d):
    tagged = runs(spark, d).withColumn("config", F.concat(F.lit("config "), F.col("run")))
    return rounded(evals.compare_all_configs(tagged, "query_id", "config", ["total", "recall"]))


@query("e15_band_labels", f"""WITH {SQL_TYPES}
SELECT query_id, run, CASE WHEN (hi - lo) / 100 >= 0.20 THEN 'differentiated' WHEN (hi - lo) / 100 < 0.10 THEN 'flat' ELSE 'moderate' END AS spread_band,
 CASE WHEN total >= 3 THEN 'pass' WHEN total >= 2 THEN 'warn' ELSE 'fail' END AS rubric_band,
 CASE WHEN query_id % 5 + 1 IN (1, 2) THEN CASE WHEN recall >= 0.45 THEN 'close' WHEN recall < 0.25 THEN 'low' ELSE 'moderate' END WHEN query_id % 5 + 1 = 3 THEN 'partial expected' WHEN recall >= 0.30 THEN 'good' ELSE 'low' END AS grounding,
 CASE WHEN precision + recall BETWEEN 0.7 AND 1.3 THEN 'normal' WHEN precision + recall > 1.3 THEN 'retrieved_heavy' ELSE 'ideal_heavy' END AS ratio_band FROM ty""")
def e15(spark, d):
    return runs(spark, d).select(
        "query_id", "run", evals.spread_band((F.col("hi") - F.col("lo")) / 100).alias("spread_band"),
        evals.rubric_band(F.col("total")).alias("rubric_band"),
        evals.grounding_band(F.col("recall"), F.col("query_id") % 5 + 1).alias("grounding"),
        evals.ratio_band(F.col("precision") + F.col("recall")).alias("ratio_band"),
    )


@query("e16_required_columns", """
SELECT 'events' AS source, 'score' AS missing, count(*) AS n_rows FROM events UNION ALL SELECT 'labels', 'value,score', count(*) FROM labels""")
def e16(spark, d):
    out = None
    for name in ("events", "labels"):
        df = table(spark, d, name)
        lost = ",".join(evals.missing_columns(df, ["value", "score"]))
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("source"), F.lit(lost).alias("missing"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("e17_result_table", f"""WITH {SQL_TYPES}
SELECT query_id, left(category, 20) AS category, CASE WHEN n_events % 3 = 0 THEN 'yes' WHEN n_events % 3 = 1 THEN 'no' ELSE '?' END AS task,
 CASE WHEN got IS NULL THEN '?' WHEN got = expected THEN 'yes' ELSE 'no' END AS synthesis, round(round(precision, 2) + 1e-9, 6) AS precision, round(round(recall, 2) + 1e-9, 6) AS recall,
 CASE WHEN recall > 0 THEN 1 ELSE 0 END::DOUBLE AS ceiling_precision, n_events, round(rubric + 1e-9, 6) AS rubric_total FROM ty""")
def e17(spark, d):
    n = F.col("n_events") % 3
    rows = typed(spark, d).select(
        "query_id", "category", F.when(n < 2, n == 0).alias("task_correct"), (F.col("got") == F.col("expected")).alias("synthesis_correct"),
        "precision", "recall", F.when(F.col("recall") > 0, 1.0).alias("ceiling_precision"), "n_events", F.col("rubric").alias("rubric_total"),
    )
    return rounded(evals.result_table(rows))


@query("e18_metric_bands", f"""WITH {SQL_TYPES}
SELECT query_id, run, CASE WHEN precision >= 0.4 THEN 'pass' WHEN precision > 0 THEN 'warn' ELSE 'fail' END AS precision_band, CASE WHEN recall >= 0.5 THEN 'pass' WHEN recall > 0 THEN 'warn' ELSE 'fail' END AS recall_band,
 CASE WHEN n_events * 40 >= CASE expected WHEN 'T1' THEN 50 WHEN 'T2' THEN 100 WHEN 'T3' THEN 150 WHEN 'T4' THEN 200 ELSE 300 END THEN 'pass' ELSE 'warn' END AS length_band FROM ty""")
def e18(spark, d):
    return typed(spark, d).select(
        "query_id", "run", evals.metric_band(F.col("precision"), 0.4).alias("precision_band"),
        evals.metric_band(F.col("recall"), 0.5).alias("recall_band"),
        evals.length_band(F.col("n_events") * 40, F.col("expected")).alias("length_band"),
    )


@query("e19_group_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'signup')")
def e19(spark, d):
    return evals.in_groups(table(spark, d, "events"), "event_type", ["click", "signup"]).select("event_id", "event_type")
