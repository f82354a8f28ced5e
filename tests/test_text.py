"""Text expressions against plain-Python models of the same rules."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.functions import stem, text as tx
from textloom.operators import overlap, outputs


def one(spark, value, expr, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).first()["r"]


def pack(parts, target=700, limit=900):
    """Sealed when the next part does not fit, or as soon as an overfull piece reaches the target."""
    done, cur = [], ""
    for p in parts:
        joined = f"{cur}\n\n{p}" if cur else p
        if not cur or len(joined) <= limit:
            cur = joined
        elif len(cur) >= target:
            done.append(cur)
            cur = p
        else:
            done.append(joined)
            cur = ""
    return done + ([cur] if cur else [])


def test_packing_follows_the_model_and_loses_no_word(spark):
    rng = random.Random(7)
    rows = [(i, [("w" * rng.randint(1, 9) + " ") * rng.randint(1, 150) + "x" for _ in range(rng.randint(0, 12))]) for i in range(60)]
    got = spark.createDataFrame(rows, "i int, parts array<string>").select("i", tx.pack_parts(F.col("parts")).alias("c")).collect()
    for r in got:
        parts = dict(rows)[r["i"]]
        assert r["c"] == pack(parts)
        assert " ".join(r["c"]).split() == " ".join(parts).split()


def test_packing_golden_case(spark):
    parts = ["a" * 650, "b" * 200, "c" * 300]
    assert [len(c) for c in one(spark, parts, tx.pack_parts, "v array<string>")] == [852, 300]


def test_segments(spark):
    words = [f"w{i}" for i in range(230)]
    got = one(spark, " ".join(words), tx.word_segments)
    assert [s.split()[0] for s in got] == ["w0", "w50", "w100", "w150", "w200"] and len(got[-1].split()) == 30
    assert one(spark, "", tx.word_segments) == []


def test_sentences_keep_abbreviations(spark):
    text = "Mr. Clay spoke. He left!  Then Gov. Hale came? yes. The end"
    assert one(spark, text, tx.sentences) == ["Mr. Clay spoke.", "He left!", "Then Gov. Hale came? yes.", "The end"]


@pytest.mark.parametrize("raw, label, number", [
    ("Text #: 007", "Text #: 7", 7), (" 42 ", "Text #: 42", 42), ("none", "none", None), ("  ", None, None), (None, None, None),
])
def test_ids(spark, raw, label, number):
    assert one(spark, raw, tx.id_label) == label and one(spark, raw, tx.id_number) == number


def test_combined_field_round_trip(spark):
    df = spark.createDataFrame([("Text #: 1", "src", "ctx", "Full Text:\nthe body\nof it", "sum", ["a", "b"], "")], "a string, b string, c string, d string, e string, f array<string>, g string")
    c = df.select(tx.combined_field(*[F.col(x) for x in "abcdefg"]).alias("c"))
    assert c.first()["c"].endswith("Summary: sum\n\nKeywords: a, b")
    assert c.select(tx.body_between(F.col("c")).alias("b")).first()["b"] == "the body\nof it"


def test_strict_form(spark):
    text = "``It's “so”—he said… [Cheers.] the ‘café's’ well-known\\n  end''"
    # The mark left by decomposing the accent is no word character, so the apostrophe after it goes.
    assert one(spark, text, tx.strict_form) == unicodedata.normalize("NFKD", "it's so he said... the cafés well known end")


def test_whole_word_pattern(spark):
    df = spark.createDataFrame([("a.b", "xa.b a.b, a.bc"), ("c++", "c++x c++ c++"), ("--", "a--b a -- b")], "k string, t string")
    got = [r[0] for r in df.select(F.regexp_count("t", tx.whole_word_pattern(F.col("k")))).collect()]
    want = [len(re.findall(rf"\b{re.escape(k)}\b", t)) for k, t in [("a.b", "xa.b a.b, a.bc"), ("c++", "c++x c++ c++"), ("--", "a--b a -- b")]]
    assert got == want == [1, 1, 1]


def test_highlight(spark):
    df = spark.createDataFrame([("To be, or not to be; that is all. To be, and to be.", "to be...be"), ("a.b A.B axb", "a.b")], "t string, q string")
    got = [r[0] for r in df.select(tx.highlight(F.col("t"), F.col("q"))).collect()]
    assert got[0].startswith("<mark>To be, or not to be;</mark>") and got[1].startswith("<mark>a.b </mark><mark>A.B </mark>")


def test_lcs_against_the_table_method():
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert overlap.lcs_length(a, b) == table(a, b)


def test_rouge_l_and_identical_bleu(spark):
    pairs = spark.createDataFrame([("p", "the cat sat on the mat", "the cat lay on a mat"), ("q", "a b c d e", "a b c d e"), ("r", "x", "")], "pair_id string, candidate string, reference string")
    lcs = {r["pair_id"]: r["rouge_l"] for r in overlap.rouge_l(pairs).collect()}
    assert lcs["p"] == pytest.approx(4 / 6) and lcs["q"] == 1.0 and lcs["r"] == 0.0
    bleu = {r["pair_id"]: r["bleu"] for r in overlap.bleu(pairs).collect()}
    assert bleu["q"] == pytest.approx(1.0) and bleu["p"] == 0.0 and bleu["r"] == 0.0


def test_confidence_rules(spark):
    rows = [(1, False, 0.9, 1), (0, True, 0.9, 1), (0, False, 0.2, 2), (0, False, 0.0, 3), (0, False, 0.45, 1), (0, False, 0.3, 4), (0, False, 0.3, 1)]
    df = spark.createDataFrame(rows, "n int, w boolean, r double, s int")
    got = [r[0] for r in df.select(outputs.confidence(F.col("n"), F.col("w"), F.col("r"), F.col("s"))).collect()]
    assert got == ["low", "low", "low", "high", "high", "high", "medium"]


# The examples of the paper that describes the steps, each with its stem after all of them.
STEMS = """
caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall
hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr
hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
""".split()


def plain_stem(word):
    """The steps letter by letter, as a check of the patterns."""
    def consonant(w, i):
        return w[i] not in "aeiou" and not (w[i] == "y" and i > 0 and consonant(w, i - 1))

    def measure(w):
        kinds = [consonant(w, i) for i in range(len(w))]
        return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)

    def vowel(w):
        return any(not consonant(w, i) for i in range(len(w)))

    def double(w):
        return len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1)

    def short(w):
        n = len(w)
        return n > 2 and consonant(w, n - 1) and not consonant(w, n - 2) and consonant(w, n - 3) and w[-1] not in "wxy"

    w = word
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w[-1] == "s" and w[-2] != "s":
        w = w[:-1]
    ending = next((e for e in ("eed", "ed", "ing") if w.endswith(e)), "")
    base = w[: len(w) - len(ending)]
    if ending == "eed":
        w = w[:-1] if measure(base) > 0 else w
    elif ending and vowel(base):
        w = base
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and short(w):
            w += "e"
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for table, least in ((stem.SECOND, 1), (stem.THIRD, 1), (stem.FOURTH, 2)):
        ending = max((e for e in table if w.endswith(e)), key=len, default=None)
        if ending:
            base = w[: -len(ending)]
            if measure(base) >= least and (ending != "ion" or base[-1:] in ("s", "t")):
                w = base + table[ending]
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


def test_stems(spark):
    known = dict(zip(STEMS[::2], STEMS[1::2]))
    rng = random.Random(3)
    heads = ["".join(rng.choice("aeioubcdlmnrstwxyyz1") for _ in range(rng.randrange(0, 7))) for _ in range(1500)]
    ends = ["", "s", "es", "ies", "ed", "eed", "ing", "y", "e", "ll", "yy", "sses", *stem.SECOND, *stem.THIRD, *stem.FOURTH]
    made = {h + rng.choice(ends) + rng.choice(["", "", "s", "ed", "ing", "ly"]) for h in heads} | {"", "a", "by", "syy", "ayyy"}
    words = spark.createDataFrame([(w,) for w in [*known, *known, *made]] + [(None,)], "token string")
    got = {r.token: r.stem for r in stem.porter_stems(words).collect()}
    assert got.pop(None) is None
    assert {w: got[w] for w in known} == known
    assert got == {w: plain_stem(w) for w in {*known, *made}}
