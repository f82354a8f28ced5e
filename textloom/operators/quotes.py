"""Checking quoted passages against the chunk they cite and against the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from textloom.functions import forms, text as tx
from textloom.functions.forms import STOPWORDS
from textloom.operators.needles import beside, covering_texts, document_counts, look_up
from textloom.operators.skew import heavy_keys, salted_join
from textloom.session import cut_lineage

# Thresholds of the checks.
MIN_PASSAGE, MIN_CONTENT_WORDS = 5, 6
VERIFIED_COVERAGE, APPROXIMATE_CITED, APPROXIMATE_ELSEWHERE = 0.95, 0.86, 0.90
OUTCOMES = [
    "verified", "approximate_quote", "displacement", "approximate_displacement", "fabrication",
    "source_mislabeled",
]


def in_order(body: Column, segments: Column) -> Column:
    """True if every segment is found at or after the end of the one before."""
    def advance(pos: Column, seg: Column) -> Column:
        at = F.when(pos > 0, F.position(seg, body, pos)).otherwise(F.lit(0))
        return F.when(at > 0, at + F.length(seg)).otherwise(F.lit(0))

    end = F.aggregate(segments, F.lit(1), advance)
    return (F.length(body) > 0) & (F.size(segments) > 0) & (end > 0)


def content_words(loose: Column) -> Column:
    """Distinct words of three or more characters that are not stopwords."""
    words = F.array_distinct(F.split(loose, " "))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS))


def coverage(quote_words: Column, chunk_words: Column) -> Column:
    """Share of the quote's content words the chunk has; 0 for fewer than six."""
    shared = F.size(F.array_intersect(quote_words, chunk_words)).cast("double")
    return F.when(F.size(quote_words) < MIN_CONTENT_WORDS, F.lit(0.0)).otherwise(shared / F.size(quote_words))


def windows(quote: Column, shortest: int, word_start: bool = False, share: float = 0.0) -> Column:
    """Substrings of 60 characters (or the whole quote) and shorter, longest first.

    Lengths shrink by 10 down to ``shortest``; starts advance by 10. With ``word_start`` a
    substring must begin a word; with ``share`` it must make up that share of the quote.
    """
    none = F.array().cast("array<int>")

    def cuts(q: Column) -> Column:
        n = F.length(q)
        longest = F.least(n, F.lit(60))
        sizes = F.when(longest >= shortest, F.sequence(longest, F.lit(shortest), F.lit(-10))).otherwise(none)
        if share:
            sizes = F.filter(sizes, lambda w: w / n >= share)

        def of_size(w: Column) -> Column:
            starts = F.sequence(F.lit(1), n - w + 1, F.lit(10))
            if word_start:
                starts = F.filter(starts, lambda s: (s == 1) | (F.substring(q, s - 1, F.lit(1)) == " "))
            return F.transform(starts, lambda s: F.substring(q, s, w))

        return F.flatten(F.transform(sizes, of_size))

    return F.coalesce(tx.let(quote, cuts), F.array().cast("array<string>"))


def any_window(cuts: Column, body: Column) -> Column:
    return (F.length(body) > 0) & F.exists(cuts, lambda w: F.contains(body, w))


def first_window(cuts: Column, body: Column) -> Column:
    return F.try_element_at(F.filter(cuts, lambda w: F.contains(body, w)), F.lit(1))


QUOTE_FORMS = "q_strict string, q_loose string, s_strict array<string>, s_loose array<string>, q_words array<string>"


def prepare_quotes(quotes: DataFrame, passage: str) -> DataFrame:
    """Add the normal forms of the passage (``forms.quote_forms``)."""
    added = StructType.fromDDL(QUOTE_FORMS)
    types = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(*(q := forms.quote_forms(p)), q.words()) for p in batch.column(passage).to_pylist()]
            new = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added.names])

    return quotes.mapInArrow(run, StructType([*quotes.schema.fields, *added.fields]))


def prepare_corpus(corpus: DataFrame, text: str) -> DataFrame:
    """Normal forms of every chunk; worth storing where many quote tables meet one corpus."""
    return corpus.withColumn("c_strict", tx.strict_form(F.col(text))).withColumn("c_loose", tx.loose_form(F.col("c_strict")))


def stored_forms(corpus: DataFrame, chunk_id: str, text: str) -> DataFrame:
    """The strict forms of a corpus, written once; loose forms are made of them where asked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [forms.strict(forms.decomposed(t or "")) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(chunk_id), pa.array(made, pa.string())], [chunk_id, "c_strict"])

    kind = corpus.schema[chunk_id].dataType.simpleString()
    return cut_lineage(corpus.select(chunk_id, text).mapInArrow(run, f"{chunk_id} {kind}, c_strict string"), "corpus-forms")


def _cited_method(chunk: forms.Chunk, q: forms.QuoteForms) -> tuple[str | None, float | None]:
    if forms.in_order(chunk.strict, q.s_strict):
        return "strict_segments", None
    if forms.in_order(chunk.loose, q.s_loose):
        return "loose_segments", None
    if any(w in chunk.strict for w in forms.least_windows(q.q_strict, 30)):
        return "sliding_window", None
    # The words of a whole chunk are compared only for quotes that no cheaper test settles.
    cover = _covered(chunk, q.words())
    if cover >= VERIFIED_COVERAGE:
        return "token_coverage", cover
    return ("approximate", cover) if cover >= APPROXIMATE_CITED else (None, None)


def _covered(chunk: forms.Chunk, words: list[str]) -> float:
    return sum(w in chunk.words for w in words) / len(words) if len(words) >= MIN_CONTENT_WORDS else 0.0


def check_cited(quotes: DataFrame, passage: str, corpus: DataFrame, cited: str, chunk_id: str) -> DataFrame:
    """Compare each quote with the one chunk it cites: ``cited_found``, ``method`` and ``score`` or null.

    The normal forms of a quote are made in the same task, and kept where it is still open.
    """
    def judge(chunk: forms.Chunk | None, asked: tuple) -> tuple:
        q = forms.quote_forms(asked[0])
        method, score = _cited_method(chunk, q) if chunk is not None and chunk.strict else (None, None)
        kept = (q.q_strict, q.s_strict, q.s_loose, q.words()) if method is None else (None,) * 4
        return chunk is not None, method, score, *kept

    schema = "cited_found boolean, method string, score double, q_strict string, s_strict array<string>, s_loose array<string>, q_words array<string>"
    return beside(quotes, cited, corpus, chunk_id, [passage], schema, judge)


def _needles(quotes: DataFrame) -> DataFrame:
    """``owner, form, segs``: what the strict (0) or loose (1) form of a chunk holds that holds segments or a window.

    A strict form with a segment has a loose form with the loose segment, so a quote that is one segment is looked for
    in loose forms only.
    """
    def asked(strict: list[str], loose: list[str], quote: str) -> Iterator[tuple[int, list[str]]]:
        if strict and not (len(strict) == len(loose) == 1 and forms.loose(strict[0]) == loose[0]):
            yield 0, strict
        if loose:
            yield 1, loose
        for w in forms.least_windows(quote, 50, True, 0.5):
            yield 0, [w]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("owner", "s_strict", "s_loose", "q_strict")), strict=True)
            made = [(owner, *needle) for owner, *own in rows for needle in asked(*own)]
            types = [pa.int64(), pa.int32(), pa.list_(pa.string())]
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, ["owner", "form", "segs"])

    return quotes.select("owner", "s_strict", "s_loose", "q_strict").mapInArrow(run, "owner bigint, form int, segs array<string>")


def _covering(quotes: DataFrame, corpus: DataFrame, chunk_id: str) -> DataFrame:
    """``owner, id, cover`` of the chunks that hold enough of the words of a quote."""
    # Coverage of .90 leaves at most a tenth of the words out, so one of the n/10 + 1 rarest is in.
    n = F.size("q_words")
    either = quotes.select("owner", F.explode("q_words").alias("term"), (F.floor(n / 10) + 1).cast("int").alias("keep"))
    freq = cut_lineage(document_counts(corpus, chunk_id, cut_lineage(either.select("term").distinct(), "asked-words")), "word-counts")
    sized = either.join(freq, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # The words of one quote, bounded by its length.
    listed = sized.groupBy("owner", "keep").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("t"))
    held = F.filter(F.slice("t", F.lit(1), F.col("keep")), lambda t: t["df"] > 0)
    rarest = listed.select("owner", F.transform(held, lambda t: t["term"]).alias("rarest")).filter(F.size("rarest") > 0)
    rarest = cut_lineage(quotes.join(rarest, "owner"), "rarest-words")
    return covering_texts(corpus, chunk_id, rarest, APPROXIMATE_ELSEWHERE)


def search_corpus(quotes: DataFrame, quote_id: str, corpus: DataFrame, chunk_id: str) -> DataFrame:
    """Best chunk of a prepared corpus per prepared quote: ``quote_id, match_id, method, score``.

    The first chunk with a strict, loose or window match wins; without one, the chunk with the
    highest coverage of at least .90, the first on ties. Quotes with the same normal forms are searched once.
    """
    own = ["q_strict", "s_strict", "s_loose", "q_words"]
    named = quotes.select(quote_id, F.sha2(F.to_json(F.struct(*own)), 256).alias("form"), *own)
    # Short numbers stand for the quotes, as there are many pairs of a quote and a chunk.
    distinct = named.select("form", *own).dropDuplicates(["form"]).withColumn("owner", F.monotonically_increasing_id())
    distinct = cut_lineage(distinct, "distinct-quotes")
    found = _search(distinct, corpus, chunk_id).join(distinct.select("owner", "form"), "owner").drop("owner")
    found = found.withColumn("match_id", F.col("match_id").cast(corpus.schema[chunk_id].dataType))
    load = named.groupBy("form").agg(F.count("*").alias("n"))
    return salted_join(named.select(quote_id, "form"), found, "form", heavy_keys(load, "form", "n"), F.col(quote_id)).drop("form")


def _search(quotes: DataFrame, corpus: DataFrame, chunk_id: str) -> DataFrame:
    """The words of a quote are looked up and compared only where no chunk holds its segments or windows."""
    hits = cut_lineage(_segment_hits(quotes, corpus, chunk_id), "segment-hits")
    rest = quotes.join(hits.select("owner"), "owner", "left_anti").filter(F.size("q_words") >= MIN_CONTENT_WORDS).select("owner", "q_words")
    rest = cut_lineage(rest, "uncovered-quotes")
    covered = cut_lineage(_covering(rest, corpus, chunk_id), "covering-candidates")
    best = covered.groupBy("owner").agg(F.max(F.struct("cover", (-F.col("id")).alias("neg_id"))).alias("best"))
    by_words = best.select(
        "owner", (-F.col("best.neg_id")).alias("match_id"), F.lit("token_coverage").alias("method"), F.col("best.cover").alias("score")
    )
    return hits.withColumn("score", F.lit(None).cast("double")).unionByName(by_words)


def _segment_hits(quotes: DataFrame, corpus: DataFrame, chunk_id: str) -> DataFrame:
    """``owner, match_id, method`` of quotes with segments or windows in some chunk. Equal needles are looked up once."""
    asked = cut_lineage(_needles(quotes), "asked-needles")
    needles = asked.select("form", "segs").distinct().withColumn("needle", F.monotonically_increasing_id())
    needles = cut_lineage(needles, "needles")
    met = cut_lineage(look_up(corpus, chunk_id, needles), "needle-candidates")

    def held(chunk: forms.Chunk | None, given: tuple) -> tuple | None:
        form, segs = given
        found = chunk is not None and forms.in_order(chunk.loose if form else chunk.strict, segs)
        return (True,) if found else None

    tested = beside(met.filter("not sure").join(needles, "needle"), "id", corpus, chunk_id, ["form", "segs"], "held boolean", held)
    first = met.filter("sure").select("needle", "id").unionByName(tested.select("needle", "id")).groupBy("needle").agg(F.min("id").alias("id"))
    hits = asked.join(needles.join(first, "needle"), ["form", "segs"]).groupBy("owner").agg(F.min("id").alias("match_id"))
    hits = cut_lineage(hits.join(quotes.select("owner", "q_strict", "s_strict", "s_loose"), "owner"), "first-chunks")

    def method(chunk: forms.Chunk | None, given: tuple) -> tuple | None:
        quote, strict, loose = given
        if chunk is None:
            return None
        if forms.in_order(chunk.strict, strict):
            return ("strict_segments",)
        if forms.in_order(chunk.loose, loose):
            return ("loose_segments",)
        return ("sliding_window",) if any(w in chunk.strict for w in forms.least_windows(quote, 50, True, 0.5)) else None

    # Chunks that share an id may hold a quote in several ways, of which the first name counts.
    named = beside(hits, "match_id", corpus, chunk_id, ["q_strict", "s_strict", "s_loose"], "method string", method)
    return named.groupBy("owner", "match_id").agg(F.min("method").alias("method"))


def verify_quotes(
    quotes: DataFrame, corpus: DataFrame, quote_id: str, passage: str, cited: str, chunk_id: str, text: str,
    prepared: bool = False,
) -> DataFrame:
    """``outcome, method, score, match_id`` for every quote.

    Quotes resolved by their cited chunk leave before the corpus-wide search, which scans the corpus for what quotes
    ask for. The strict forms of the corpus are computed and stored once, about its text (``prepared``: the corpus
    already holds the columns of ``prepare_corpus``).
    """
    chunks = corpus if prepared else stored_forms(corpus, chunk_id, text)
    stored = cut_lineage(quotes, "quotes")
    long_enough = F.length(tx.strip(F.coalesce(passage, F.lit("")))) >= MIN_PASSAGE
    short = stored.filter(~long_enough)
    checked = cut_lineage(check_cited(stored.filter(long_enough), passage, chunks, cited, chunk_id), "cited-checks")
    open_quotes = checked.filter("method is null")
    found = search_corpus(open_quotes, quote_id, chunks, chunk_id)
    elsewhere = open_quotes.drop("method", "score").join(found, quote_id, "left")
    keep = quotes.columns
    verdict = (
        F.when(F.col("method").isNull(), "fabrication")
        .when(F.col("score") < VERIFIED_COVERAGE, "approximate_displacement")
        .otherwise("displacement")
    )
    settled = checked.filter("method is not null").select(
        *keep, "cited_found",
        F.when(F.col("method") == "approximate", "approximate_quote").otherwise("verified").alias("outcome"),
        F.when(F.col("method") == "approximate", "token_coverage").otherwise(F.col("method")).alias("method"),
        "score", F.col(cited).cast("long").alias("match_id"),
    )
    rest = elsewhere.select(*keep, "cited_found", verdict.alias("outcome"), "method", "score", F.col("match_id").cast("long"))
    known = chunks.select(F.col(chunk_id).alias(cited), F.lit(True).alias("cited_found"))
    brief = short.join(known, cited, "left").select(
        *keep, F.coalesce("cited_found", F.lit(False)).alias("cited_found"), F.lit("too_short").alias("outcome"),
        F.lit(None).cast("string").alias("method"), F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("long").alias("match_id"),
    )
    return settled.unionByName(rest).unionByName(brief)


def same_source(actual: Column, claimed: Column) -> Column:
    """True if two source labels share at least .35 of the words of the longer one, or one is empty."""
    def words(c: Column) -> Column:
        c = F.regexp_replace(tx.strip(c), rf"(?i)^source:{tx.SPACE}*", "")
        c = F.lower(tx.squeeze(F.regexp_replace(c, r"[.,;:\-()]", " ")))
        return F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) > 2))

    a, b = words(F.coalesce(actual, F.lit(""))), words(F.coalesce(claimed, F.lit("")))
    bigger = F.greatest(F.size(a), F.size(b))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return empty | (F.size(F.array_intersect(a, b)) / F.when(bigger > 0, bigger) >= 0.35)


def verify_matches(
    answers: DataFrame, query_id: str, matches: str, ranked: DataFrame, corpus: DataFrame, chunk_id: str,
    source: str, text: str, prepared: bool = False,
) -> DataFrame:
    """Check every entry of a match map ``name -> struct(text_id, source, key_quote)``.

    ``ranked(query_id, chunk_id, rank)`` tells whether the cited chunk was retrieved at all.
    """
    flat = answers.select(query_id, F.explode(matches).alias("match", "m")).select(
        query_id, "match", F.col("m.text_id").alias("text_id"), F.col("m.source").alias("claimed_source"),
        F.col("m.key_quote").alias("passage"), tx.id_number(F.col("m.text_id")).alias("cited"),
    )
    flat = flat.withColumn("quote_id", F.concat_ws("\u0001", F.col(query_id), "match"))
    checked = verify_quotes(flat, corpus, "quote_id", "passage", "cited", chunk_id, text, prepared)
    actual = corpus.select(F.col(chunk_id).alias("cited"), F.col(source).alias("actual_source"))
    ranks = ranked.select(query_id, F.col(chunk_id).alias("cited"), F.col("rank").alias("cited_rank"))
    full = checked.join(actual, "cited", "left").join(ranks, [query_id, "cited"], "left")
    wrong_label = (
        (F.col("outcome") == "verified")
        & (F.coalesce(tx.strip(F.col("claimed_source")), F.lit("")) != "")
        & ~same_source(F.col("actual_source"), F.col("claimed_source"))
    )
    return (
        full.withColumn("outcome", F.when(wrong_label, "source_mislabeled").otherwise(F.col("outcome")))
        .withColumn("cited_in_top", F.col("cited_rank").isNotNull())
        .drop("quote_id")
    )


def outcome_counts(verified: DataFrame, query_id: str) -> DataFrame:
    return verified.groupBy(query_id).agg(
        *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES]
    )


# ---- quotes inside an answer ------------------------------------------------------------

# Opening and closing quote marks, in search order.
QUOTE_MARKS = [("“", "”"), ('"', '"'), ("‘", "’"), ("'", "'")]


def inline_quotes(text: Column, least: int = 15) -> Column:
    """Quoted spans as ``struct(style, span)``. Straight marks must not stand inside a word."""
    found = []
    for style, (a, b) in enumerate(QUOTE_MARKS):
        if a == b:
            pattern = rf"(?<![{tx.WORD_CHAR}]){a}([^\n]{{{least},}}?){b}(?![{tx.WORD_CHAR}])"
        else:
            pattern = rf"{a}([^\n]{{{least},}}?){b}"
        spans = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        kind = F.lit(style).alias("style")
        found.append(F.transform(spans, lambda s: F.struct(kind, s.alias("span"))))
    return F.concat(*found)


def _trim_marks(c: Column) -> Column:
    marks = ".,;:!? “”‘’\"'"
    return F.btrim(F.lower(c), F.lit(marks))


def mark_answer(text: Column, passage: Column, mark: Column) -> Column:
    """Put ``mark`` after the first quoted copy of ``passage`` in ``text``.

    A verbatim quoted copy is preferred; otherwise the quoted span of at least 15 characters
    that contains the passage, or lies in it, with the largest overlap.
    """
    def wrapped(style: int, c: Column) -> Column:
        a, b = QUOTE_MARKS[style]
        return F.concat(F.lit(a), c, F.lit(b))

    def insert(span: Column) -> Column:
        at = F.position(span, text)
        end = at + F.length(span)
        return F.concat(
            F.substring(text, F.lit(1), end - 1), F.lit(" "), mark, F.substring(text, end, F.length(text))
        )

    exact = F.coalesce(*[F.when(F.contains(text, wrapped(k, passage)), wrapped(k, passage)) for k in range(4)])
    wanted = _trim_marks(passage)
    scored = F.transform(
        inline_quotes(text),
        lambda q, i: F.struct(
            F.when(
                (F.length(_trim_marks(q["span"])) >= 15)
                & (F.contains(wanted, _trim_marks(q["span"])) | F.contains(_trim_marks(q["span"]), wanted)),
                F.least(F.length(_trim_marks(q["span"])), F.length(wanted)),
            ).alias("n"),
            (-i).alias("first"), q["style"].alias("style"), q["span"].alias("span"),
        ),
    )
    best = F.array_max(F.filter(scored, lambda s: s["n"].isNotNull()))
    style = best["style"]
    near = F.when(style == 0, wrapped(0, best["span"])).when(style == 1, wrapped(1, best["span"])).when(
        style == 2, wrapped(2, best["span"])
    ).otherwise(wrapped(3, best["span"]))
    span = F.coalesce(exact, F.when(best.isNotNull(), near))
    return F.when((F.length(passage) > 0) & span.isNotNull(), insert(span)).otherwise(text)


def cited_ids(matches: Column) -> Column:
    """Numbers of the cited texts in match order, each once."""
    numbers = F.transform(F.map_values(matches), lambda m: tx.id_number(m["text_id"]))
    return F.array_distinct(F.filter(numbers, lambda n: n.isNotNull()))


def missing_citations(answers: DataFrame, query_id: str, matches: str, corpus: DataFrame, chunk_id: str) -> DataFrame:
    cited = answers.select(query_id, F.explode(cited_ids(F.col(matches))).alias("cited"))
    return cited.join(corpus.select(F.col(chunk_id).alias("cited")), "cited", "left_anti").select(query_id, "cited")
