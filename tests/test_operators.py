"""Operators on golden micro-tables and against brute force."""

import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import sf_dir
from textloom import schemas
from textloom.functions import arrow, forms, text as tx
from textloom.operators import (
    containment, curate, enrich, evals, fusion, irmetrics, keyword, needles, numbering, overlap, prep, quotes, skew, termstats, vector,
)
from textloom.plans import pipeline_queries, source_queries
from textloom.plans.catalog import QUERIES as CATALOG
from textloom.sources import files, results

# ---- quotes ---------------------------------------------------------------------------------


def test_every_sentence_is_verified(spark, tmp_path):
    """Documents of one sentence take part, and so do sentences beyond the second."""
    texts = {
        4: "Only one sentence about the quiet harbour stands here.",
        8: "First comes the river valley. Then the northern mountain road. Later an old wooden bridge. Last the empty market square.",
        12: "Nobody quotes this document at all. It has two sentences.",
        16: "A wrong citation names the next document. Its second sentence is cited there as well.",
    }
    rows = [(k, x, "en", "src", len(x)) for k, x in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (8, 1, 0), (16, 0, 0)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(4, texts[4])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.quote_id: (r.outcome, r.match_id) for r in CATALOG["v7_every_sentence"](spark, str(tmp_path)).collect()}
    want = {"b4": ("verified", 4), "l4s1": ("verified", 4)} | {f"l8s{k}": ("verified", 8) for k in range(1, 5)}
    assert got == want | {f"l16s{k}": ("displacement", 16) for k in (1, 2)}


def test_short_quotes_find_their_first_text(spark):
    """Quotes without an inner word, on one row or many, with cut words, gaps and marks: as a scan of all texts says."""
    rng = random.Random(5)
    words = ["sea", "season", "overseas", "re", "réen", "ball", "football", "ballad", "x", "ten"]
    gaps = [" ", " ", " ", ", ", "!! ", " (", "_ ", "... "]
    def sentence(n):
        return "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n)).strip()
    chunks = [sentence(rng.randrange(1, 12)) for _ in range(40)]
    cases = ["sea ball", "eason, foot", "réen!!", "overseas football", "overseas...football", "alad (se", "seaball", "overseas season...football ballad"]
    cases += [sentence(rng.choice([1, 2, 2, 3])) for _ in range(60)]
    corpus = spark.createDataFrame(list(enumerate(chunks)), "chunk_id long, full_text string")
    prepared = quotes.prepare_corpus(corpus, "full_text")
    asked = quotes.prepare_quotes(spark.createDataFrame(list(enumerate(cases * 2)), "quote_id long, passage string"), "passage")
    got = {r.quote_id: (r.match_id, r.method) for r in quotes.search_corpus(asked, "quote_id", prepared, "chunk_id").collect()}
    forms = [(r.chunk_id, r.c_strict, r.c_loose) for r in prepared.orderBy("chunk_id").collect()]

    def in_order(segments, body):
        at = 0
        for s in segments:
            at = body.find(s, at)
            if at < 0:
                return False
            at += len(s)
        return bool(segments) and body != ""

    want = {}
    for q in asked.collect():
        assert len(q.q_words) < quotes.MIN_CONTENT_WORDS and len(q.q_strict) < 50  # coverage and windows take no part
        for chunk_id, strict, loose in forms:
            method = "strict_segments" if in_order(q.s_strict, strict) else "loose_segments" if in_order(q.s_loose, loose) else None
            if method:
                want[q.quote_id] = (chunk_id, method)
                break
    assert got == want and 20 < len(want) < 2 * len(cases)


def verify(spark, chunks, cases):
    corpus = spark.createDataFrame(list(enumerate(chunks)), "chunk_id long, text string")
    rows = spark.createDataFrame([(str(i), p, c) for i, (p, c) in enumerate(cases)], "quote_id string, passage string, cited long")
    out = quotes.verify_quotes(rows, corpus, "quote_id", "passage", "cited", "chunk_id", "text").collect()
    return {int(r["quote_id"]): r for r in out}


WORDS = "liberty nation dedicated proposition created equal fathers continent conceived testing endure battlefield resting place living rather".split()


def test_coverage_thresholds(spark):
    base = [f"word{i:03d}" for i in range(100)]
    chunk = " filler ".join(base)
    other = "nothing of the kind stands in this chunk at all"

    def quote(kept):
        # Reversed order and foreign words: only coverage can match.
        return " ".join(base[:kept][::-1] + [f"alien{i:03d}" for i in range(100 - kept)])

    got = verify(spark, [chunk, other], [(quote(95), 0), (quote(94), 0), (quote(86), 0), (quote(85), 0),
                                         (quote(95), 1), (quote(90), 1), (quote(89), 1)])
    assert [got[i]["outcome"] for i in range(7)] == [
        "verified", "approximate_quote", "approximate_quote", "fabrication", "displacement", "approximate_displacement", "fabrication",
    ]


def test_stages_and_edge_cases(spark):
    chunks = [
        "The old harbour closed, and trade moved inland throughout the northern provinces for nine years.",
        "A house divided against itself cannot stand. I believe this government cannot endure.",
        "It is for us the living, rather, to be dedicated here to the unfinished work... they gave.",
    ]
    fabricated = "He told us that the new council had paid for the walls so that trade moved inland throughout the northern province"
    got = verify(spark, chunks, [
        ("A house divided against itself cannot stand.", 1),
        ("A HOUSE divided, against itself; cannot stand", 1),
        ("house divided against itself ... government cannot endure", 1),
        ("house divided against itself cannot stand", 0),
        (fabricated, 1), ("four", 1), ("", None), ("ided against", 0), ("unfinished work", None), ("entirely unknown words of nobody", 7),
    ])
    assert [got[i]["outcome"] for i in range(10)] == [
        "verified", "verified", "verified", "displacement", "fabrication", "too_short", "too_short", "displacement", "displacement", "fabrication",
    ]
    assert got[0]["method"] == "strict_segments" and got[1]["method"] == "loose_segments"
    assert got[3]["match_id"] == 1 and got[7]["match_id"] == 1 and not got[9]["cited_found"]


def model_strict(s):
    s = unicodedata.normalize("NFKD", s).replace("-", " ").lower()
    return " ".join(s.split())


def test_pruned_search_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = WORDS + ["of", "the", "a", "in", "naïve", "œuvre"]
    chunks = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 60))) for _ in range(60)]
    cases = []
    for _ in range(80):
        src = rng.choice(chunks)
        start = rng.randrange(len(src))
        cases.append((src[start:start + rng.randint(4, 90)], None))
    cases += [("of the", None), ("aaa", None), ("?!?!?!", None), ("e o", None)]
    got = verify(spark, chunks, cases)
    for i, (p, _) in enumerate(cases):
        need = model_strict(p)
        if len(p.strip()) < 5:
            assert got[i]["outcome"] == "too_short"
            continue
        exact = [k for k, c in enumerate(chunks) if need and need in model_strict(c)]
        if exact:
            # An earlier chunk can win only through the loose or window test.
            assert got[i]["outcome"] == "displacement" and got[i]["match_id"] <= exact[0]
            if got[i]["method"] == "strict_segments":
                assert got[i]["match_id"] == exact[0]


def test_containment_join_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab -,é") for _ in range(rng.randint(0, 40))) for _ in range(50)]
    needles = list({"".join(rng.choice("ab -,é") for _ in range(rng.randint(1, 9))) for _ in range(120)})
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "needle_id int, needle string")
    got = {tuple(r) for r in containment.containment_join(n, "needle_id", "needle", t, "text_id", "text").collect()}
    assert got == {(i, j) for i, x in enumerate(needles) for j, y in enumerate(texts) if x in y}


def test_source_agreement(spark):
    rows = [("At Dover, Kent. March 3, 1931.", "Dover Lecture (1931)", True), ("First debate, Ottawa, 1858", "Speech to the Lyceum, Springfield, 1838", False), ("", "x", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.select((quotes.same_source(F.col("a"), F.col("b")) == F.col("want")).alias("ok")).filter("not ok").count() == 0


# ---- keywords ---------------------------------------------------------------------------------

CORPUS = "chunk_id long, source string, full_text string, summary string, keywords array<string>"
PLANS = "query_id long, weighted_keywords map<string,double>, year_keywords array<int>, text_keywords array<string>"


@pytest.fixture(scope="module")
def small(spark):
    corpus = spark.createDataFrame([
        (0, "Peoria. October 16, 1854", "slavery slavery union", "about slavery", ["kansas"]),
        (1, "Source: Cooper Union, 1860", "union men of the house divided", "", []),
        (2, "Letter 1854", "nothing here", "a note on kansas-nebraska", []),
    ], CORPUS)
    terms = spark.createDataFrame([("slavery", 2, 1), ("union", 2, 2), ("house", 1, 1), ("men", 1, 1)], "term string, raw_freq long, doc_freq long")
    return corpus, terms


def test_weights_and_unconstrained_lift(spark, small):
    corpus, terms = small
    plans = spark.createDataFrame([(1, {"Slavery": 1.0, "zebra": 1.0, "house divided": 1.0}, [], [])], PLANS)
    w = {r["keyword"]: r["weight"] for r in keyword.keyword_weights(plans, terms).collect()}
    assert w == {"Slavery": 5.0, "zebra": 10.0, "house divided": 10.0}
    hits = keyword.keyword_search(corpus, terms, plans, 5).orderBy("rank").collect()
    assert [(h["chunk_id"], round(h["score"], 6)) for h in hits] == [(0, round(3 * 5 * 2.7, 6)), (1, 27.0)]
    assert hits[0]["keyword_counts"] == {"Slavery": 3} and hits[1]["keyword_counts"] == {"house divided": 1}


def test_constraints_buckets_and_metadata_snippet(spark, small):
    corpus, terms = small
    plans = spark.createDataFrame([(1, {"kansas": 1.0, "union": 1.0}, [1854], ["Peoria"])], PLANS)
    hits = keyword.keyword_search(corpus, terms, plans, 5).orderBy("rank").collect()
    assert [h["chunk_id"] for h in hits] == [0, 2, 1]
    assert hits[1]["quote"] == "[match in metadata] nothing here"
    strict = keyword.keyword_search(corpus, terms, plans, 5, boost="strict").collect()
    assert [h["chunk_id"] for h in strict] == [0]


@pytest.mark.parametrize("boost", ["multiply", "add", "strict"])
def test_scores_of_leaders_give_the_same_hits(spark, boost):
    """Only scores that can be among the first hits leave their task; constraints, ties and null sources included."""
    rng = random.Random(3)
    sources = ["Source: s1 1861", "s2 1862", "s3 1863", None]
    words = ["war", "peace", "union", "slavery"]
    rows = [(i % 350, rng.choice(sources), " ".join(rng.choices(words, k=rng.randint(1, 6))), None, None) for i in range(400)]
    corpus = spark.createDataFrame(rows, "chunk_id long, source string, full_text string, summary string, keywords array<string>")
    plans = spark.createDataFrame([
        (1, {"war": 1.0, "peace": 2.0}, [], []), (2, {"union": 1.0, "war": 3.0}, [1861], []),
        (3, {"slavery": 1.0}, [1862], ["s2"]), (3, {"slavery": 1.0}, [], ["s1 1861"]),
    ], PLANS)
    terms = termstats.term_table(corpus, F.col("full_text"))
    weights = keyword.keyword_weights(plans, terms)
    scores = [keyword.keyword_scores(corpus, weights, boost == "strict", boost != "strict", best=n) for n in (None, 5)]
    every, few = (sorted(map(tuple, keyword.ranked_hits(keyword.constrained(s, plans, boost), 5).collect()), key=str) for s in scores)
    assert every == few and len(every) > 5
    assert scores[1].count() < scores[0].count()


def test_words_are_those_of_the_pattern(spark):
    texts = ["Ñandú—«größe» x_1, ٣٤ a\u00a0b", "", None, "  ,.", "a\tb\x00c\x1fd\x7fe¿é?", "ИМЯ İstanbul ﬁn 𝔘𝔫 😀ok", "last word"] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    runs = docs.select(F.explode(tx.word_runs(F.col("t"))).alias("term"))
    want = {r.term: r["count"] for r in runs.groupBy("term").count().collect()}
    assert {r.term: r.raw_freq for r in termstats.term_table(docs, F.col("t")).collect()} == want
    part = pa.array(["left out", "a, b", "", " c "]).slice(1)
    sizes, words = arrow.split_words(part)
    assert sizes.tolist() == [2, 0, 1] and words.to_pylist() == ["a", "b", "c"]


def test_gaps_are_exploded_for_edges_only(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "one quiet little harbour"), (2, "one quiet big harbour")], "text_id long, text string")
    needles = spark.createDataFrame([(7, "e quiet little ha")], "needle_id long, needle string")
    monkeypatch.setattr(containment, "all_runs", lambda c: pytest.fail("no needle asks for gaps"))
    found = containment.containment_join(needles, "needle_id", "needle", texts, "text_id", "text").collect()
    assert [tuple(r) for r in found] == [(7, 1)]


def test_lines_of_documents_are_embedded_once(spark):
    late = pipeline_queries.found_hits(spark, sf_dir("0.001"))[2]
    # What is left are the tokens of the queries, collected before.
    assert "MapInPandas" not in late._jdf.queryExecution().toString()


def test_shuffled_keyword_path_equals_broadcast_path(spark, small, monkeypatch):
    corpus, terms = small
    plans = spark.createDataFrame([(i, {"union": 1.0, "slavery": 2.0, "--": 1.0}, [], []) for i in range(5)], PLANS)
    weights = keyword.keyword_weights(plans, terms)
    usual = sorted(map(tuple, keyword.keyword_scores(corpus, weights).collect()))
    monkeypatch.setattr(keyword, "broadcast_if_small", lambda df: df)
    assert sorted(map(tuple, keyword.keyword_scores(corpus, weights).collect())) == usual


def test_scores_of_blocks_equal_plain_sums(spark, monkeypatch):
    # Repeated and null chunks and sources, repeated keywords, a word in two spellings, a word without a text.
    bodies = [(1, "s1", "war and war peace"), (1, "s1", "War"), (None, "s1", "peace peace"), (2, None, "größe war"), (3, "s1", "none"), (4, "s2", None)]
    corpus = spark.createDataFrame([(c, s, t, None, None) for c, s, t in bodies], "chunk_id long, source string, full_text string, summary string, keywords array<string>")
    asked = [("a", "war", 2.0), ("a", "War", 1.0), ("b", "peace", 3.0), ("b", "größe", 0.5), (None, "war", 1.0), ("c", "absent", 1.0), ("c", "war", 0.0)]
    weights = spark.createDataFrame([(q, k, k.lower(), 1.0, w) for q, k, w in asked], "query_id string, keyword string, key string, user_weight double, weight double")
    for size in (1, keyword.BLOCK_MATCHES):
        monkeypatch.setattr(keyword, "BLOCK_MATCHES", size)
        got = {(r.query_id, r.chunk_id, r.source): r.score for r in keyword.keyword_scores(corpus, weights).collect()}
        assert got == {("a", 1, "s1"): 9.0, ("a", 2, None): 3.0, ("b", 1, "s1"): 3.0, ("b", None, "s1"): 6.0, ("b", 2, None): 0.5, (None, 1, "s1"): 3.0, (None, 2, None): 1.0}
        strict = {(r.query_id, r.chunk_id): r.score for r in keyword.keyword_scores(corpus, weights, strict=True).collect()}
        assert strict == {("a", 1): 27.0, ("a", 2): 3.0, ("b", 1): 3.0, ("b", None): 12.0, ("b", 2): 0.5, (None, 1): 9.0, (None, 2): 1.0}
    labels = {(r.source, r.label) for r in keyword.keyword_scores(corpus, weights, labelled=True).collect()}
    assert labels == {("s1", "s1"), (None, "")}


def test_words_are_counted_in_their_task(spark):
    docs = spark.createDataFrame([("a b a",), ("A--ä b",), ("a b a",), ("",), (" ?",), (None,)], "t string").repartition(3)
    table = termstats.term_table(docs, F.col("t"))
    assert sorted(map(tuple, table.collect())) == [("a", 5, 3), ("b", 3, 3), ("ä", 1, 1)]
    assert "Generate" not in table._jdf.queryExecution().executedPlan().toString()


def test_ngrams_stay_in_their_task(spark):
    rows = [("1", "a b a b c", "a b c a b"), ("2", "", "x"), ("3", None, None), ("4", "a\u00a0b", "a b"), ("5", "x y z w v", "x y z w"), (None, "a b", "a b")]
    pairs = spark.createDataFrame(rows, "pair_id string, candidate string, reference string")
    got = overlap.gram_overlap(pairs, (1, 2, 4), "space")
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    named = pairs.filter("pair_id is not null")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, overlap._joint_overlap(named, (1, 2, 4), "space").collect()))
    # Pairs with one id count together, as before.
    twice = pairs.unionByName(spark.createDataFrame([("1", "c c", "c d")], pairs.schema))
    both = overlap.gram_overlap(twice, (1, 2), "words").collect()
    assert sorted(map(tuple, both)) == sorted(map(tuple, overlap._joint_overlap(twice.filter("pair_id is not null"), (1, 2), "words").collect()))
    assert {r.pair_id: r.bleu for r in overlap.bleu(twice).collect()}[None] == 0.0 and overlap.bleu(twice).count() == 7


def test_quotes_of_common_words_meet_few_texts(spark, monkeypatch):
    filler = " ".join(f"word{k}" for k in range(12))
    texts = [(i, f"{filler}. The {i} of a day. It is x{i} in the end, and so on.") for i in range(40)]
    corpus = spark.createDataFrame([*texts, (50, f"Now x9 of it in {filler}, all word77 said.")], "chunk_id long, text string")
    said = [(1, "the 7 of a day. It is x7 in"), (2, "x9 of it"), (3, "day. It"), (4, "word1 word3 word5 word7 word9 word77 word0 word2"), (5, "x9 of the it")]
    asked = spark.createDataFrame([(str(k), q, 99) for k, q in said], "quote_id string, passage string, cited long")
    sizes = {}
    old = quotes.cut_lineage
    monkeypatch.setattr(quotes, "cut_lineage", lambda df, name: (out := old(df, name), sizes.update({name: out.count()}))[0])
    got = quotes.verify_quotes(asked, corpus, "quote_id", "passage", "cited", "chunk_id", "text").collect()
    assert {r.quote_id: (r.match_id, r.method) for r in got} == {
        "1": (7, "strict_segments"), "2": (50, "strict_segments"), "3": (0, "strict_segments"), "4": (50, "token_coverage"), "5": (None, None),
    }
    assert sizes["needle-candidates"] <= 6  # one text for each quote and form that occurs
    assert sizes["covering-candidates"] <= 1


def test_forms_equal_those_of_columns(spark):
    rng = random.Random(11)
    signs = list("abcX Yz01_.,;!?-–—[]…`'\"‘’“”\n\r\t\\éÖßΣςİﬁ①½Жя中\u0301\u00a0\u2028\u0085\x1c＂") + ["...", "``", "\'\'", "\\n", "[x]", " ", "  "]
    texts = [None, "", "“…”", "'a'"] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(800)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("strict", tx.strict_form(F.col("t")))
    for r in rows.withColumn("loose", tx.loose_form(F.col("strict"))).collect():
        strict = forms.strict(forms.decomposed(r.t or ""))
        assert (strict, forms.loose(strict)) == (r.strict, r.loose)
    quote = "one two three four five six seven eight nine ten eleven, twelve thirteen fourteen fifteen"
    every = spark.createDataFrame([(quote[:n],) for n in range(90)], "q string").select(
        "q", quotes.windows(F.col("q"), 30).alias("a"), quotes.windows(F.col("q"), 50, True, 0.5).alias("b")
    ).collect()
    for r in every:
        for all_windows, least in ((r.a, forms.least_windows(r.q, 30)), (r.b, forms.least_windows(r.q, 50, True, 0.5))):
            assert set(least) <= set(all_windows) and all(any(x in w for x in least) for w in all_windows)


def test_needles_of_any_length_find_their_texts(spark, monkeypatch):
    """Against a scan of all texts: cut words, letters of several bytes, ends of texts, small parts and blocks."""
    monkeypatch.setattr(needles, "SCAN_BYTES", 300)
    monkeypatch.setattr(needles, "BLOCK", 150)
    rng = random.Random(4)
    words = ["sea", "overseas", "of", "the", "größe", "a", "ten,", "мир", "it's", "x-y", "of the", "overseas sea of the ten"]
    texts = [(rng.choice([None, *range(30)]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for _ in range(70)]
    corpus = spark.createDataFrame(texts, "chunk_id long, t string").select("chunk_id", F.lower("t").alias("c_strict"))
    bodies = [[(k, t.lower()) for k, t in texts if k is not None and t]]
    bodies.append([(k, forms.loose(t)) for k, t in bodies[0]])
    asked = []
    for _ in range(500):
        form = rng.randrange(2)
        body = rng.choice(bodies[form])[1]
        cuts = [body[a:a + rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 20, 31, 32, 33, 50, 90])] for a in sorted(rng.choices(range(max(1, len(body))), k=rng.choice([1, 1, 1, 2])))]
        if all(cuts):
            asked.append((form, cuts))
    asked += [(0, ["zzyzx"]), (1, ["s on"]), (0, ["overseas sea of the ten overseas sea of the tin"])]
    asked = [a for i, a in enumerate(asked) if a not in asked[:i]]
    table = spark.createDataFrame([(i, f, s) for i, (f, s) in enumerate(asked)], "needle long, form int, segs array<string>")
    got = {}
    for r in needles.look_up(corpus, "chunk_id", table).collect():
        got.setdefault(r.needle, set()).add((r.id, r.sure))
    for i, (form, segs) in enumerate(asked):
        want = {k for k, body in bodies[form] if forms.in_order(body, segs)}
        found = got.get(i, set())
        if len(segs) == 1 and len(segs[0].encode()) < needles.PIECE:
            assert found == ({(min(want), True)} if want else set()), segs
        else:
            assert want <= {k for k, _ in found} and not any(sure for _, sure in found), segs


def test_common_short_quotes_meet_one_text(spark, monkeypatch):
    texts = [(i, f"The {i}nd was by the sea, and {i} said so to whom it may concern.") for i in range(60)]
    corpus = spark.createDataFrame(texts, "chunk_id long, text string")
    said = [(1, "as by the s"), (2, "id so to wh"), (3, "was by the sea and 41 said so"), (4, "41 said so to whom"), (5, "was by a sea")]
    asked = spark.createDataFrame([(str(k), q, 99) for k, q in said], "quote_id string, passage string, cited long")
    sizes, columns = {}, {}
    old = quotes.cut_lineage
    monkeypatch.setattr(quotes, "cut_lineage", lambda df, name: (out := old(df, name), sizes.update({name: out.count()}), columns.update({name: out.columns}))[0])
    got = quotes.verify_quotes(asked, corpus, "quote_id", "passage", "cited", "chunk_id", "text").collect()
    assert {r.quote_id: (r.match_id, r.method) for r in got} == {
        "1": (0, "strict_segments"), "2": (0, "strict_segments"), "3": (41, "loose_segments"), "4": (41, "strict_segments"), "5": (None, None),
    }
    assert sizes["needle-candidates"] == 4  # not one for each text that holds the words of the first two
    assert columns["corpus-forms"] == ["chunk_id", "c_strict"]  # loose forms are made where asked


def test_words_of_quotes_are_compared_where_the_text_lies(spark, monkeypatch):
    for name, size in (("SCAN_BYTES", 200), ("QUOTE_BLOCK", 20), ("COMPARED", 30), ("BLOCK", 25)):
        monkeypatch.setattr(needles, name, size)
    rng = random.Random(8)
    vocabulary = [f"word{k}" for k in range(40)]
    texts = [(rng.choice([None, *range(50)]), " ".join(rng.sample(vocabulary, rng.randint(0, 30)))) for _ in range(60)]
    corpus = spark.createDataFrame(texts, "chunk_id long, c_strict string")
    asked = {k: rng.sample([*vocabulary, "absent"], rng.randint(6, 25)) for k in range(60)}
    asked |= {60 + k: rng.sample(t.split(), len(t.split())) for k, (_, t) in enumerate(texts) if len(t.split()) >= 6}
    table = spark.createDataFrame(list(asked.items()), "owner long, q_words array<string>")
    got = sorted((r.owner, r.id, r.cover) for r in quotes._covering(table, corpus, "chunk_id").collect())
    shares = [(o, i, len({*q} & {*t.split()}) / len(q)) for o, q in asked.items() for i, t in texts if i is not None]
    assert got == sorted(s for s in shares if s[2] >= quotes.APPROXIMATE_ELSEWHERE) and len(got) > 20
    assert "Join" not in quotes.covering_texts(corpus, "chunk_id", table.withColumn("rarest", F.col("q_words")), 0.9)._jdf.queryExecution().toString()


def test_quotes_beside_repeated_and_missing_chunks(spark):
    texts = [(1, "The quiet harbour of the old town"), (1, "the quiet harbour, of the old town"), (None, "a mountain road without a number"), (2, None), (3, "")]
    corpus = spark.createDataFrame(texts, "chunk_id long, text string")
    rows = [("a", "quiet harbour of the old", 1), ("b", "quiet harbour of the old", 2), ("c", "quiet harbour of the old", None), ("d", "a mountain road without", None), ("e", "no", 1), ("f", None, 3)]
    asked = spark.createDataFrame(rows * 20, "quote_id string, passage string, cited long").distinct()
    got = quotes.verify_quotes(asked, corpus, "quote_id", "passage", "cited", "chunk_id", "text").collect()
    assert sorted((r.quote_id, r.cited_found, r.outcome, str(r.method), r.match_id or 0) for r in got) == [
        ("a", True, "verified", "loose_segments", 1), ("a", True, "verified", "strict_segments", 1),
        ("b", True, "displacement", "loose_segments", 1), ("c", False, "displacement", "loose_segments", 1),
        ("d", False, "fabrication", "None", 0), ("e", True, "too_short", "None", 0), ("e", True, "too_short", "None", 0), ("f", True, "too_short", "None", 0),
    ]


def test_terms_of_one_word_are_found_in_their_task(spark, monkeypatch):
    texts = [(1, "The Größe of it, the SIZE"), (1, "the rest"), (2, None), (None, "the size"), (3, "size--größe x_1"), (4, "of it!"), (4, "of it!")]
    asked = [("a", "THE"), ("a", "rest"), ("b", "the"), (None, "size"), ("c", "größe"), ("d", "x_1"), ("e", ""), ("f", "absent"), ("g", "of"), ("g", "of")]
    body = spark.createDataFrame(texts, "doc_id long, text string")
    terms = spark.createDataFrame(asked, "term_id string, term string")
    want = sorted((t, d) for t, w in asked for d, x in texts if t and w and d and x and w.lower() in tx_words(x))
    with monkeypatch.context() as m:
        m.setattr(containment, "candidates", lambda *a: pytest.fail("a word needs no test of the text"))
        assert sorted(map(tuple, containment.term_hits(terms, "term_id", "term", body, "doc_id", "text").collect())) == want
        m.setattr(containment, "BROADCAST_LIMIT", 0)
        assert sorted(map(tuple, containment.term_hits(terms, "term_id", "term", body, "doc_id", "text").collect())) == want
    more = terms.unionByName(spark.createDataFrame([("h", "size--"), ("i", "of it"), ("j", "--")], terms.schema))
    got = sorted(map(tuple, containment.term_hits(more, "term_id", "term", body, "doc_id", "text").collect()))
    assert got == sorted([*want, ("h", 3), ("i", 1), ("i", 4), ("i", 4), ("j", 3)])


def tx_words(text):
    return re.findall(r"\w+", text.lower())


def test_word_pairs_are_counted_in_one_scan_and_tasks_stay_small(spark, monkeypatch):
    rows = [(1, "s", "na na na na. Na-na, so so well", None, None), (1, "s", "so well", None, None), (2, None, "so  well, so", None, None)]
    corpus = spark.createDataFrame(rows, "chunk_id long, source string, full_text string, summary string, keywords array<string>")
    asked = [(7, k, k, 1.0, 1.0) for k in ("na na", "so well", "so so", "na-na", "na, so so")] + [(8, "so", "so", 1.0, 2.0)]
    weights = spark.createDataFrame(asked, "query_id long, keyword string, key string, user_weight double, weight double")
    looked = []
    old = keyword._phrase_counts
    monkeypatch.setattr(keyword, "_phrase_counts", lambda c, keys: looked.extend(r.key for r in keys.collect()) or old(c, keys))
    monkeypatch.setattr(keyword, "TASK_MATCHES", 1)
    scores = keyword.keyword_scores(corpus, weights)
    assert looked == ["na, so so"]  # every other keyword is counted where the text is scanned
    got = {(r.query_id, r.chunk_id, r.source): r.score for r in scores.collect()}
    assert got == {(7, 1, "s"): 2 + 2 + 1 + 1 + 1, (8, 1, "s"): 6.0, (8, 2, None): 4.0}
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan  # pairs of query and chunk are not shuffled
    squared = {(r.query_id, r.chunk_id): r.score for r in keyword.keyword_scores(corpus, weights, strict=True).collect()}
    assert squared == {(7, 1): 4 + 4 + 1 + 1 + 1, (8, 1): 18.0, (8, 2): 8.0}


# ---- vectors -----------------------------------------------------------------------------------


def test_cosine_blocks_agree_with_numpy(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    x[5] = x[9]
    x[11] = 0
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ unit.T
    want = {(i, int(c), r + 1) for i in range(7) for r, c in enumerate(np.lexsort((np.arange(300), -np.round(sims[i], 9)))[:4])}
    for limit, held in ((10**6, vector.SIMILARITIES), (200, 40)):
        monkeypatch.setattr(vector, "SIMILARITIES", held)  # few corpus rows at a time
        got = vector.cosine_top(corpus, queries, 4, limit=limit).collect()
        assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in got} == want


def test_vectors_of_other_lengths_raise(spark):
    corpus = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, None)], "query_id long, token_id long, embedding array<double>")
    for found in (vector.cosine_top(corpus, asked), vector.late_interaction_top(corpus, asked)):
        with pytest.raises(Exception, match="expected 2 values, found 1"):
            found.collect()
    some = vector.cosine_top(corpus.filter("chunk_id = 1").union(spark.createDataFrame([(3, None)], corpus.schema)), asked)
    assert [(r["query_id"], r["chunk_id"]) for r in some.collect()] == [(1, 1)]
    assert vector.cosine_top(corpus, asked.limit(0)).count() == vector.late_interaction_top(corpus, asked.limit(0)).count() == 0


@pytest.mark.parametrize("heavy", [True, False])
def test_late_interaction_blocks_agree(spark, monkeypatch, heavy):
    if not heavy:  # all documents are scored in one sorted partition
        monkeypatch.setattr(vector, "heavy_keys", lambda counts, key, n: counts.select(key).limit(0))
    rng = np.random.default_rng(1)
    docs = [(int(i % 9), rng.normal(size=4).tolist()) for i in range(90)]
    toks = [(i // 3, i % 3, rng.normal(size=4).tolist()) for i in range(6)]
    d = spark.createDataFrame(docs, "chunk_id long, embedding array<double>")
    t = spark.createDataFrame(toks, "query_id long, token_id long, embedding array<double>")
    found = []
    for limit, held in ((10**6, vector.SIMILARITIES), (40, 18)):
        monkeypatch.setattr(vector, "SIMILARITIES", held)
        rows = vector.late_interaction_top(d, t, 9, limit=limit).collect()
        found.append(sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in rows))
    a, b = found

    def unit(v):
        return np.array(v) / np.linalg.norm(v)

    best = {(q, c): sum(max(unit(e) @ unit(v) for k, v in docs if k == c) for p, _, e in toks if p == q) for q in (0, 1) for c in range(9)}
    assert a == b and all(s == pytest.approx(best[q, c]) for q, _, c, s in a)


# ---- metrics and analytics -------------------------------------------------------------------------


def test_fifteen_hits_with_one_ideal(spark):
    hits = spark.createDataFrame([("q", i, i + 1) for i in range(15)], "query_id string, chunk_id long, rank long")
    qrels = spark.createDataFrame([("q", 3), ("none", 1)], "query_id string, chunk_id long")
    got = {r["query_id"]: r for r in irmetrics.precision_recall(hits, qrels).collect()}
    assert got["q"]["precision"] == 0.0667 and got["q"]["recall"] == 1.0 and got["q"]["ceiling_precision"] == 1.0
    assert got["none"]["recall"] == 0.0
    at5 = irmetrics.precision_recall(hits, qrels, 5).filter("query_id = 'q'").first()
    assert at5["precision"] == 0.2
    assert irmetrics.hit_and_miss(hits, qrels).filter("query_id = 'q' and status = 'missed'").count() == 0


def test_ndcg_variants(spark):
    hits = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, chunk_id long, rank long")
    qrels = spark.createDataFrame([("q", 2), ("q", 9)], "query_id string, chunk_id long")
    full = irmetrics.ranking_metrics(hits, qrels).first()
    own = irmetrics.ranking_metrics(hits, qrels, ideal="retrieved").first()
    low = 1 / np.log2(3)
    assert full["ndcg"] == pytest.approx(low / (1 + low)) and own["ndcg"] == pytest.approx(low) and full["mrr"] == 0.5


def test_five_totals(spark):
    runs = spark.createDataFrame([("Q7", v) for v in (3.75, 3.5, 3.75, 3.75, 3.5)], "qid string, total double")
    r = evals.run_summary(runs, ["qid"], ["total"]).first()
    assert r["total_mean"] == pytest.approx(3.65) and round(r["total_sd"], 4) == 0.1369


def test_bootstrap_does_not_depend_on_partitions(spark):
    obs = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("v"))
    a = evals.bootstrap_interval(obs.repartition(1), "id", "v", resamples=200).first()
    b = evals.bootstrap_interval(obs.repartition(13, "v"), "id", "v", resamples=200).first()
    mean, se = 3.0, 2.0 / 3000 ** 0.5
    assert a["ci_low"] == pytest.approx(b["ci_low"]) and a["n_replicates"] == 200
    assert a["ci_low"] < mean < a["ci_high"] and (a["ci_high"] - a["ci_low"]) == pytest.approx(3.92 * se, rel=0.25)


# ---- numbering, skew, fusion ------------------------------------------------------------------------


def test_offsets_over_several_blocks(spark):
    df = spark.range(500).select((F.col("id") * 3).alias("k"), (F.col("id") % 4).alias("n"))
    got = {r["k"]: r["offset"] for r in numbering.running_offsets(df, "k", "n", fan=8).collect()}
    total = 0
    for i in range(500):
        assert got[i * 3] == total
        total += i % 4


def test_neighbours_cross_block_edges(spark):
    df = spark.range(30).select(F.lit("s").alias("g"), F.col("id").alias("p"), F.col("id").cast("string").alias("v"))
    got = {r["p"]: r["near"] for r in numbering.with_neighbours(df, "g", "p", "v", 2, "near", block=4).collect()}
    assert all(got[p] == [str(x) for x in range(max(0, p - 2), min(29, p + 2) + 1)] for p in range(30))


def test_salted_join_keeps_every_pair(spark):
    many = spark.range(1000).select(F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("500", 3)], "k string, x int")
    heavy = skew.heavy_keys(many.groupBy("k").agg(F.count("*").alias("n")), "k", "n", 10)
    assert [r["k"] for r in heavy.collect()] == ["hot"]
    assert skew.salted_join(many, few, "k", heavy, F.col("id")).count() == 801


def test_dedupe_is_idempotent(spark):
    rows = [("q", "Text #: 1", "Semantic", 0.9, 1, None), ("q", "Text #: 1", "Keyword", 0.5, 2, "quote"), ("q", "Text #: 2", "ColBERT", 0.1, 1, None)]
    hits = spark.createDataFrame(rows, "query_id string, text_id string, search_type string, score double, rank int, key_quote string")
    once = fusion.dedupe_hits(hits)
    assert sorted(r["search_type"] for r in once.collect()) == ["ColBERT", "Keyword"]
    assert sorted(map(tuple, fusion.dedupe_hits(once).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(r["search_type"] for r in fusion.dedupe_hits(hits, "score").collect()) == ["ColBERT", "Semantic"]


def test_chunks_are_numbered_over_all_texts(spark):
    docs = spark.createDataFrame([(i * 5000, f"Source:  s{i}", "\n\n".join(["p" * 600] * (i % 4))) for i in range(9)], "n long, source string, text string")
    got = prep.build_chunks(docs, "n", "source", "text").orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in got] == list(range(len(got))) and [r["n"] for r in got] == sorted(r["n"] for r in got)
    assert got[0]["chunk_context"] == "From the s1, passage 1 of 1."


def test_structural_checks_report_gaps(spark):
    rows = spark.createDataFrame([(0, "a", [1.0]), (2, " ", [1.0, 2.0])], "i long, t string, e array<double>")
    got = {r["check"]: r["failing"] for r in termstats.structural_checks(rows, "i", F.col("t"), "e", 1).collect()}
    assert got == {"sequential_ids": 1, "empty_text": 1, "vector_length": 1}


# ---- curation, enrichment, sources ---------------------------------------------------------------------


def test_conversation_rules(spark):
    rows = [("a", 0, "system", "s"), ("a", 1, "user", "u"), ("a", 2, "assistant", "{\"k\": 1}"),
            ("b", 0, "system", "s"), ("b", 1, "user", "u"), ("b", 2, "assistant", "not json"),
            ("c", 0, "user", "u"), ("c", 1, "system", "s"), ("c", 2, "assistant", "{}")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: (r["roles_ok"], r["json_ok"], r["valid"]) for r in curate.validate_conversations(df).collect()}
    assert got == {"a": (True, True, True), "b": (True, False, False), "c": (False, True, False)}


def test_phrase_audit_with_nulls_and_empty_phrases(spark):
    answers = spark.createDataFrame(
        [(1, "about 10,000 men"), (2, "the corpus figure corrects this"), (3, "none"), (4, None)], "example_id int, answer string"
    )
    phrases = [("forbidden", "10,000"), ("required", "Corrects"), ("required", "corpus fig"), ("required", ""), ("forbidden", None)]
    got = curate.phrase_audit(answers, spark.createDataFrame(phrases, "kind string, phrase string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0, False), (2, 0, 2, True), (3, 0, 0, False), (4, 0, 0, False)]
    none = curate.phrase_audit(answers, spark.createDataFrame([], "kind string, phrase string"))
    assert {r["passed"] for r in none.collect()} == {False}


def test_repeated_updates_raise(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    merged, unknown = results.update_results(stored, spark.createDataFrame([(1, "c"), (9, "d")], "id int, v string"), "id")
    assert sorted(map(tuple, merged.collect())) == [(1, "c"), (2, "b")] and [r["id"] for r in unknown.collect()] == [9]
    twice, _ = results.update_results(stored, spark.createDataFrame([(1, "c"), (1, "d")], "id int, v string"), "id")
    with pytest.raises(Exception, match="several updates of 1"):
        twice.collect()


def test_broken_files_raise(spark, tmp_path):
    (tmp_path / "lines.jsonl").write_text('{"messages": []}\n{"messages": [\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "lines.jsonl")).collect()
    table = '{"corpusTerms": {"total": 3,\n "terms": [{"term": "sea", "rawFreq": 3, "inDocumentsCount": 2}]}}'
    (tmp_path / "terms.json").write_text(table)
    with pytest.raises(Exception, match="no term table"):
        files.read_term_table(spark, str(tmp_path / "terms.json")).collect()
    assert [tuple(r) for r in files.read_term_table(spark, str(tmp_path / "terms.json"), lines=False).collect()] == [("sea", 3, 2)]


def test_resume_does_each_text_once(spark, tmp_path):
    marker = tmp_path / "calls"
    marker.write_text("")

    def call(texts):
        with open(marker, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return pd.DataFrame({"n": [len(t) for t in texts]})

    path = str(tmp_path / "out")
    first = spark.createDataFrame([(1, "one"), (2, "two")], "id int, text string")
    second = spark.createDataFrame([(1, "one"), (2, "changed"), (3, "three")], "id int, text string")
    for rows in (first, first, second):
        got = {r["id"]: r["n"] for r in enrich.resume_enrichment(rows, "id", "text", path, call, "n long").collect()}
    assert got == {1: 3, 2: 7, 3: 5}
    assert sorted(marker.read_text().split()) == ["changed", "one", "three", "two"]


def test_json_array_and_wrapped_files(spark, tmp_path):
    record = '{"text_id": "Text #: 0", "full_text": "x", "keywords": ["k"]}'
    (tmp_path / "a.json").write_text(f"[{record}, {record}]")
    (tmp_path / "b.json").write_text('{"data": [' + record + "]}")
    assert files.read_corpus_json(spark, str(tmp_path / "a.json")).count() == 2
    assert files.read_corpus_json(spark, str(tmp_path / "b.json")).first()["keywords"] == ["k"]
    (tmp_path / "c.json").write_text('{"other": 1}')
    with pytest.raises(Exception, match="neither a list"):
        files.read_corpus_json(spark, str(tmp_path / "c.json")).collect()


def test_texts_take_labels_from_the_manifest(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("erste\xff".encode("latin-1"))
    (tmp_path / "a.txt").write_text("zweite")
    manifest = spark.createDataFrame([("b.txt", 0, "First"), ("a.txt", 1, "Second"), ("c.txt", 2, "Third")], "file_name string, position int, label string")
    got = [(r["label"], r["full_text"]) for r in files.read_texts(spark, str(tmp_path), manifest).orderBy("position").collect()]
    assert got == [("First", "erste�"), ("Second", "zweite"), ("Third", None)]


def test_whole_files_are_bounded(spark, monkeypatch):
    """Files grow in number with the texts, and each holds the texts whose doc_id belongs to it."""
    size = 32 * 1024
    monkeypatch.setattr(source_queries, "FILE_BYTES", size, raising=False)
    folder = sf_dir("0.001")
    docs = source_queries.documents(spark, folder).select("doc_id", (F.length("text") + 1).alias("n"), (F.octet_length("text") + 1).alias("b"))
    parts = max(4, -(-docs.agg(F.sum("b")).first()[0] // size))
    want = docs.groupBy(F.pmod(F.hash("doc_id"), F.lit(parts)).alias("part")).agg(F.sum("n").alias("n")).collect()
    got = source_queries.s8(spark, folder).collect()
    assert parts > 4 and {r.position: r.n_chars for r in got if r.n_chars} == {-r.part: r.n for r in want}
    assert all(r.label == f"label {-r.position:05d}" for r in got)


def test_index_without_ids_is_numbered(spark, tmp_path):
    spark.range(40).select(F.col("id").cast("string").alias("full_text")).repartition(3).write.parquet(str(tmp_path / "i"))
    got = [r["text_id"] for r in files.read_embedding_index(spark, str(tmp_path / "i")).collect()]
    assert sorted(got) == sorted(f"Text #: {i}" for i in range(40))


def test_layout_mismatch_is_refused(spark, tmp_path):
    path = str(tmp_path / "r")
    results.append_results(spark.createDataFrame([(1, "a")], "x long, y string"), path, "x long, y string")
    with pytest.raises(ValueError, match="layout"):
        results.append_results(spark.createDataFrame([(1, "a")], "x long, y string"), path, "y string, x long")
    with pytest.raises(ValueError, match="unknown columns"):
        results.as_layout(spark.createDataFrame([(1, 2)], "x long, z long"), "x long")


def test_missing_run_file_is_an_error_not_a_failure(spark, tmp_path):
    head = [f.split()[0] for f in schemas.RUN.split(", ")]
    (tmp_path / "merged_run_0.csv").write_text(",".join(head) + "\nQ1,query,cat,0.9,0.5,0.2,1.0,2,3,1.0,0.5,0.25,0.75\n")
    df, errors = files.read_runs(spark, [str(tmp_path / "merged_run_0.csv"), str(tmp_path / "merged_run_1.csv")])
    row = df.first()
    assert row["RubricTotal"] == 2.5 and row["Rerank"] == pytest.approx(0.4) and len(errors) == 1


def test_benchmark_log_fills_missing_scores_with_zero(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, query string")
    part = {n: spark.createDataFrame([(1, 0.5)], f"query_id long, {n} double") for n in ("bleu", "mrr", "total_score", "n_matched")}
    got = {r["query_id"]: tuple(r)[2:] for r in results.benchmark_log_rows(queries, *part.values()).collect()}
    assert got == {1: (0.5,) * 4, 2: (0.0,) * 4}
