"""Curating fine-tuning examples: audits, balance, validation, assembly and exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.containment import phrase_hits
from textloom.operators.skew import broadcast_if_small, keep_ids, top_n
from textloom.operators.termstats import keyword_class


def keyword_audit(examples: DataFrame, terms: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row per example and keyword: corpus frequency, class, and whether the target chunk has it.

    ``examples``: example_id, weighted_keywords map, chunk_id; ``chunks``: chunk_id, full_text.
    """
    kw = examples.select("example_id", "chunk_id", F.explode("weighted_keywords").alias("keyword", "weight"))
    kw = kw.withColumn("term", F.lower("keyword"))
    asked = broadcast_if_small(kw.select("term").distinct())
    freq = terms.join(asked, "term", "left_semi").select("term", "raw_freq")
    rows = kw.join(freq, "term", "left").withColumn("raw_freq", F.coalesce("raw_freq", F.lit(0)))
    rows = rows.withColumn("quality", keyword_class(F.col("raw_freq"), F.col("weight")))
    if chunks is not None:
        body = keep_ids(chunks.select("chunk_id", F.lower("full_text").alias("_body")), "chunk_id", examples)
        rows = rows.join(body, "chunk_id", "left").withColumn(
            "in_chunk", F.contains("_body", F.col("term"))
        ).drop("_body")
    return rows.drop("term")


def audit_verdict(audit: DataFrame) -> DataFrame:
    """An example passes when no keyword is absent from the corpus or weak."""
    good = ~F.col("quality").isin("ABSENT", "WEAK")
    aggs = [F.count("*").alias("n_keywords"), F.bool_and(good).alias("passed")]
    if "in_chunk" in audit.columns:
        aggs.append(F.count_if(~F.col("in_chunk")).alias("n_not_in_chunk"))
    return audit.groupBy("example_id").agg(*aggs)


def balance(examples: DataFrame, keywords: str) -> DataFrame:
    """Positives, refusals (no keywords) and whole positives per refusal."""
    none = F.coalesce(F.size(F.map_keys(keywords)), F.lit(0)) <= 0
    counts = examples.agg(F.count_if(~none).alias("n_positive"), F.count_if(none).alias("n_refusal"))
    return counts.withColumn(
        "positives_per_refusal", F.when(F.col("n_refusal") > 0, F.floor(F.col("n_positive") / F.nullif(F.col("n_refusal"), F.lit(0))))
    )


def by_section(examples: DataFrame, section: str) -> DataFrame:
    return examples.groupBy(F.coalesce(section, F.lit("?")).alias("section")).agg(F.count("*").alias("n"))


def validate_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation: are the roles system, user, assistant, and is the first answer JSON?

    Aggregates only, so a conversation of any length is never collected: three turns, the
    first from the system, the last from the assistant and one from the user fix the order.
    """
    is_json = F.try_parse_json("text").isNotNull()
    answer = F.when(F.col("role") == "assistant", F.col("turn"))
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        (
            (F.count("*") == 3) & (F.min_by("role", "turn") == "system")
            & (F.max_by("role", "turn") == "assistant") & (F.count_if(F.col("role") == "user") == 1)
        ).alias("roles_ok"),
        F.min_by(is_json, answer).alias("json_ok"),
    ).withColumn("valid", F.col("roles_ok") & F.coalesce("json_ok", F.lit(True)))


def phrase_audit(answers: DataFrame, phrases: DataFrame) -> DataFrame:
    """Forbidden phrases must be absent, at least one required phrase must be present.

    ``answers``: example_id, answer; ``phrases``: kind (forbidden or required), phrase. Phrases meet
    answers in a containment join, however many there are. A null answer holds no phrase, and null
    or empty phrases count for nothing.
    """
    listed = phrases.select("kind", F.lower("phrase").alias("phrase")).filter("phrase <> ''").distinct()
    keyed = listed.withColumn("phrase_id", F.concat_ws(":", "kind", "phrase"))
    found = phrase_hits(keyed, "phrase_id", "phrase", answers, "example_id", "answer")
    kinds = found.join(keyed.select("phrase_id", "kind"), "phrase_id")
    counts = kinds.groupBy("example_id").agg(
        F.count_if(F.col("kind") == "forbidden").alias("n_forbidden"),
        F.count_if(F.col("kind") == "required").alias("n_required"),
    )
    out = answers.select("example_id").join(counts, "example_id", "left").fillna(0, ["n_forbidden", "n_required"])
    return out.withColumn("passed", (F.col("n_forbidden") == 0) & (F.col("n_required") > 0))


def scope_audit(examples: DataFrame, relevance: str, off_target: tuple[str, ...] = ("Match 2", "Match 3")) -> DataFrame:
    """Off-target matches must be rated Low."""
    ok = F.lit(True)
    for m in off_target:
        ok = ok & F.coalesce(F.contains(F.try_element_at(relevance, F.lit(m)), F.lit("Low")), F.lit(False))
    return examples.select("example_id", ok.alias("scope_ok"))


def context_set(targets: DataFrame, corpus: DataFrame, n: int = 3) -> DataFrame:
    """Each target chunk with its next, then its previous neighbour: up to ``n`` rows per target.

    ``targets``: example_id, chunk_id; ``corpus``: chunk_id, source_file, position.
    """
    place = targets.join(corpus, "chunk_id").select("example_id", "source_file", F.col("position").alias("_at"))
    steps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(d).alias("d")) for o, d in ((0, 0), (1, 1), (2, -1))])
    wanted = place.withColumn("s", F.explode(steps)).select(
        "example_id", "source_file", (F.col("_at") + F.col("s.d")).alias("position"), F.col("s.o").alias("_order")
    )
    found = wanted.join(corpus, ["source_file", "position"])
    return top_n(found, ["example_id"], [F.col("_order")], n, "place").select("example_id", "place", "chunk_id")


def usage_log(used: DataFrame, kind: str, value: Column, section: Column) -> DataFrame:
    """Entries ``kind, value, section`` of what training examples used; placeholders are dropped."""
    return used.select(F.lit(kind).alias("kind"), value.cast("string").alias("value"), section.alias("section")).filter(
        "value is not null and value <> '' and value not like '%XX%'"
    ).distinct()


def exclude_used(benchmark: DataFrame, key: str, log: DataFrame, kind: str) -> DataFrame:
    """Benchmark rows whose key no training example used."""
    used = log.filter(F.col("kind") == kind).select(F.col("value").alias("_k")).distinct()
    return benchmark.withColumn("_k", F.col(key).cast("string")).join(used, "_k", "left_anti").drop("_k")


def merge_examples(existing: DataFrame, new: DataFrame, approved: str) -> tuple[DataFrame, DataFrame]:
    """Existing plus approved new examples, and the counts before and after."""
    chosen = new.filter(F.col(approved)).drop(approved)
    merged = existing.unionByName(chosen, allowMissingColumns=True)
    n_old, n_new = existing.select(F.count("*")).scalar(), chosen.select(F.count("*")).scalar()
    counts = existing.sparkSession.range(1).select(n_old.alias("n_existing"), n_new.alias("n_new"), (n_old + n_new).alias("n_merged"))
    return merged, counts


def training_record(system: Column, user: Column, assistant: Column) -> Column:
    """The three messages of a training example."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", system), message("user", user), message("assistant", assistant))


def example_input(query: Column, initial: Column, matches: Column) -> Column:
    """Model input from a query, a drafted answer and up to three matches (struct text_id, source, summary, full_text)."""
    entry = F.transform(
        F.slice(matches, 1, 3),
        lambda m, i: F.concat(
            F.lit("Match "), (i + 1).cast("string"), F.lit(": Text ID - "), m["text_id"], F.lit(", Source - "), m["source"],
            F.lit(", Summary - "), m["summary"],
            F.lit(", Full Text (select the most relevant passage to quote directly) - "), F.left(m["full_text"], F.lit(900)),
            F.lit(", Relevance Score - 0.82"),
        ),
    )
    return F.concat(
        F.lit("User Query: "), query, F.lit("\n\nInitial Answer: "), initial, F.lit("\n\n"), F.array_join(entry, "\n\n")
    )
