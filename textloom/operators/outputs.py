"""Reading and classifying model outputs held in JSON or text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import text as tx

# Prose labels and the task type they stand for, in order of precedence.
TASK_LABELS = [
    ("direct retrieval", "A"), ("inferential retrieval", "B"), ("absence recognition", "C"),
    ("multi-passage synthesis", "D"), ("contrastive", "E"), ("historiographical", "E"),
]
# Fields of a query plan and sections of an answer.
PLAN_FIELDS = ["initial_answer", "weighted_keywords", "year_keywords", "text_keywords", "query_assessment"]
ANSWER_SECTIONS = [
    "User Query Analysis", "Initial Answer Review", "Match Analysis", "Meta Analysis", "FinalAnswer", "Model Feedback",
]
PLAN_SCHEMA = (
    "initial_answer string, weighted_keywords map<string,double>, year_keywords array<int>, "
    "text_keywords array<string>, query_assessment string, _corrupt_record string"
)
# Wording that marks a comparative or temporal question.
COMPLEX_WORDING = (
    r"(?i)(compare|contrast|how did .+ change|evolution of|shift|differ|difference|between|throughout|across|"
    r"over time|consistent|inconsistent|develop|arc|trajectory)"
)
JUDGE_DIMENSIONS = [
    "query_response_quality", "quote_usage", "citation_accuracy", "source_integration", "historical_context",
    "response_structure",
]


def task_type(assessment: Column) -> Column:
    """A-E from ``Type X``, else from the first prose label found."""
    letter = F.upper(F.regexp_extract(assessment, rf"(?i)Type\s+([ABCDE])(?![{tx.WORD_CHAR}])", 1))
    out = F.when(letter != "", letter)
    for label, value in TASK_LABELS:
        out = out.when(F.contains(F.lower(assessment), F.lit(label)), value)
    return out


def synthesis_type(assessment: Column) -> Column:
    """T1-T5 from ``Type N``."""
    digit = F.regexp_extract(assessment, r"(?i)Type\s*([1-5])", 1)
    return F.when(digit != "", F.concat(F.lit("T"), digit))


def synthesis_number(assessment: Column) -> Column:
    """Number after ``Type``; 3 when there is none."""
    digit = F.regexp_extract(F.coalesce(assessment, F.lit("")), r"(?i)Type\s+(\d)", 1)
    return F.when(digit != "", digit.cast("long")).otherwise(F.lit(3).cast("long"))


def unknown_fields(plan_json: Column) -> Column:
    known = F.array(*[F.lit(f) for f in [*PLAN_FIELDS, "_raw", "_error"]])
    return F.array_except(F.json_object_keys(plan_json), known)


def section_flags(answer_json: Column) -> Column:
    """Map from section name to whether the answer has it."""
    keys = F.coalesce(F.json_object_keys(answer_json), F.array().cast("array<string>"))
    return F.create_map(*[x for s in ANSWER_SECTIONS for x in (F.lit(s), F.array_contains(keys, s))])


def is_complete(answer_json: Column) -> Column:
    return F.forall(F.map_values(section_flags(answer_json)), lambda f: f)


def answer_text(answer_json: Column) -> Column:
    """``FinalAnswer`` as text, whether it is a string or an object with Text or text."""
    whole = F.get_json_object(answer_json, "$.FinalAnswer")
    return F.coalesce(
        F.get_json_object(answer_json, "$.FinalAnswer.Text"), F.get_json_object(answer_json, "$.FinalAnswer.text"),
        whole, F.lit(""),
    )


def synthesis_assessment(answer_json: Column) -> Column:
    """First non-empty synthesis assessment among the sections that may hold it."""
    found = [
        F.nullif(F.get_json_object(answer_json, f"$['{s}'].synthesis_assessment"), F.lit(""))
        for s in ("User Query Analysis", "Meta Analysis")
    ]
    return F.coalesce(*found, F.lit(""))


def strip_fences(raw: Column) -> Column:
    """Remove a Markdown code fence around a model's JSON."""
    bare = F.regexp_replace(tx.strip(raw), r"^```(?:json)?\s*", "")
    return F.regexp_replace(bare, r"\s*```$", "")


def parse_plans(rows: DataFrame, raw: str, query: str) -> DataFrame:
    """Query plans from raw model output; a broken one falls back to the query as initial answer."""
    bare = strip_fences(F.col(raw))
    parsed = F.from_json(bare, PLAN_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = rows.withColumn("_bare", bare).withColumn("_p", parsed)
    bad = F.col("_p").isNull() | F.col("_p._corrupt_record").isNotNull()
    empty_map = F.from_json(F.lit("{}"), "map<string,double>")
    return rows.select(
        *[c for c in rows.columns if not c.startswith("_")],
        F.when(bad, F.col(query)).otherwise(F.coalesce("_p.initial_answer", F.lit(""))).alias("initial_answer"),
        F.when(bad, empty_map).otherwise(F.coalesce("_p.weighted_keywords", empty_map)).alias("weighted_keywords"),
        F.when(bad, F.array().cast("array<int>")).otherwise(
            F.coalesce("_p.year_keywords", F.array().cast("array<int>"))
        ).alias("year_keywords"),
        F.when(bad, F.array().cast("array<string>")).otherwise(
            F.coalesce("_p.text_keywords", F.array().cast("array<string>"))
        ).alias("text_keywords"),
        F.when(bad, F.lit("")).otherwise(F.coalesce("_p.query_assessment", F.lit(""))).alias("query_assessment"),
        F.when(bad, F.concat(F.lit("JSON parse error: "), F.left("_bare", F.lit(80)))).alias("error"),
    )


MATCH_TYPE = (
    "struct<`Text ID`:string,Source:string,Summary:string,`Key Quote`:string,`Historical Context`:string,"
    "`Relevance Assessment`:string>"
)


def match_map(answer_json: Column) -> Column:
    """``Match Analysis`` as a map to ``struct(text_id, source, key_quote, relevance)``."""
    raw = F.from_json(F.get_json_object(answer_json, "$['Match Analysis']"), f"map<string,{MATCH_TYPE}>")
    return F.transform_values(
        raw,
        lambda _, m: F.struct(
            m["Text ID"].alias("text_id"), m["Source"].alias("source"), m["Key Quote"].alias("key_quote"),
            F.coalesce(m["Relevance Assessment"], F.lit("")).alias("relevance"),
        ),
    )


def relevance_map(matches: Column) -> Column:
    return F.transform_values(matches, lambda _, m: m["relevance"])


def relevance_level(assessment: Column) -> Column:
    low = F.lower(F.coalesce(assessment, F.lit("")))
    return (
        F.when(F.contains(low, F.lit("high")), "high")
        .when(F.contains(low, F.lit("medium")) | F.contains(low, F.lit("moderate")), "medium")
        .when(F.contains(low, F.lit("low")), "low")
        .otherwise("other")
    )


def relevance_label(assessment: Column) -> Column:
    """Text before the first em dash or comma, at most 30 characters."""
    given = F.coalesce(F.nullif(assessment, F.lit("")), F.lit("N/A"))
    return F.left(tx.strip(F.element_at(F.split(given, "[—,]"), 1)), F.lit(30))


def complexity(query: Column) -> Column:
    return F.when(query.rlike(COMPLEX_WORDING), "high").otherwise("moderate")


def complexity_mismatch(query: Column, synthesis: Column) -> Column:
    return (complexity(query) == "high") & synthesis.isin(1, 2)


def task_flags(assessment: Column, expected: Column) -> list[Column]:
    """Extracted type, whether it is the expected one (null if none), and the training-bleed flag."""
    got = task_type(assessment)
    return [
        got.alias("task_type"), F.when(got.isNotNull(), got == expected).alias("task_correct"),
        F.contains(assessment, F.lit("This trains")).alias("training_bleed"),
    ]


def confidence(
    n_unverified: Column, calibration_warning: Column, rouge1: Column, synthesis: Column
) -> Column:
    """Overall confidence; the order of the rules matters. Missing ROUGE counts as 0."""
    r1, direct = F.coalesce(rouge1, F.lit(0.0)), synthesis.isin(1, 2)
    return (
        F.when(F.coalesce(n_unverified, F.lit(0)) > 0, "low")
        .when(F.coalesce(calibration_warning, F.lit(False)), "low")
        .when(direct & (r1 < 0.25), "low")
        .when(synthesis == 3, "high")
        .when(r1 >= F.when(direct, 0.45).otherwise(0.30), "high")
        .otherwise("medium")
    )


def judge_scores(rows: DataFrame, judged: str) -> DataFrame:
    """Nested judge scores flattened, 0 where missing; list fields stay JSON."""
    c = F.col(judged)
    scores = [
        F.coalesce(F.get_json_object(c, f"$.evaluation_scores.{d}.score").cast("double"), F.lit(0.0)).alias(f"{d}_score")
        for d in JUDGE_DIMENSIONS
    ]
    lists = [
        F.coalesce(F.get_json_object(c, f"$.overall_assessment.{d}"), F.lit("[]")).alias(d)
        for d in ("strengths", "weaknesses", "improvement_priorities")
    ]
    total = F.coalesce(F.get_json_object(c, "$.overall_assessment.total_score").cast("double"), F.lit(0.0))
    return rows.select(*[x for x in rows.columns if x != judged], *scores, total.alias("total_score"), *lists)


def relevant_evidence(rows: DataFrame, key: str, order: str, section: str, verdict: str) -> DataFrame:
    """Sections whose verdict calls them relevant, joined per key with their verdicts.

    A key holds the few sections shown for one question.
    """
    yes = F.col(verdict).rlike(r"(?is)Relevance Explanation.*?relevant") | F.col(verdict).rlike(
        "(?i)this section is relevant"
    )
    entry = F.concat(F.col(section), F.lit("\nKey Terms\n"), F.col(verdict))
    kept = rows.filter(yes).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("e")))).alias("m"))
    return kept.select(
        key, F.size("m").cast("long").alias("n_relevant"), F.array_join(F.transform("m", lambda x: x["e"]), "\n\n").alias("evidence")
    )


def rating_average(*scores: Column) -> Column:
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return total / len(scores)
