import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_dedup_and_sharding import ODD, odd
from textloom.llm import periodic_runs, queries, spelling, token_counts
from textloom.llm.common import new_folder

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(MODEL)


def mixed(n, seed):
    r = random.Random(seed)
    parts = [
        "a", "b", "▁", " ", "  ", "\n", "é", "中", "the", "ing", "</s>", "<unk>", "<0x0A>", "\x00", "😀", ".", "aaaa", "\t", "0", "ñ", ",",
    ]
    return ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(n)]


def test_totals_equal_library(counter, library):
    texts = [*mixed(20_000, 1), *brute.documents().values(), "", " ", "a" + " " * 700 + "b", "x" * 5000]
    assert counter.totals_of(pa.array(texts)).tolist() == [len(x) for x in library.encode(texts)]


def test_every_prefix_equals_library(counter, library):
    for text in [*mixed(400, 2), *(t[:300] for t in list(brute.documents().values())[:20]), "", " "]:
        assert counter.counts(text) == [len(library.encode(text[:i])) for i in range(len(text) + 1)], text


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 2000)
    monkeypatch.setattr(token_counts, "APART_ENTRIES", 50)
    own, texts = token_counts.PrefixCounter(MODEL), [*brute.documents().values()][:60]
    for text in texts:
        assert own.totals_of(pa.array([text])).tolist() == [len(library.encode(text))]


def test_op11_equals_library(spark, library):
    got = sorted(tuple(r) for r in queries.QUERIES["op11_token_counts"](spark, brute.FOLDER).collect())
    sizes = {i: len(library.encode(t)) for i, t in brute.documents().items()}
    assert got == [(i, len(t.encode()), sizes[i], sizes[i] > 4096) for i, t in sorted(brute.documents().items())]


def test_stored_prefixes_answer_budgets(spark, library):
    path = new_folder(spark, "prefixes")
    token_counts.store_prefixes(odd(spark), path, MODEL)
    held = spark.read.parquet(path)
    cut = held.select(
        "doc_id", "counts", token_counts.longest_within(F.col("counts"), 7).alias("longest"),
        token_counts.longest_within(F.col("counts"), -1).alias("none"),
        token_counts.tokens_before(F.col("counts"), F.lit(9)).alias("nine"),
    ).collect()
    assert len(cut) == len(ODD)
    texts = Counter((r[0], r[1] or "") for r in ODD)
    for r in cut:
        fit = [t for i, t in texts if i == r.doc_id and len(t) + 1 == len(r.counts)]
        assert fit and r.none is None
        if len(fit) == 1 and len(fit[0]) < 2000:
            sizes = [len(library.encode(fit[0][:i])) for i in range(len(fit[0]) + 1)]
            assert r.counts == sizes and r.longest == max(i for i, n in enumerate(sizes) if n <= 7)
            assert r.nine == sizes[min(9, len(fit[0]))]


def plain_runs(words):
    """start, length, period of every run, by comparison of all words at every distance."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                if j + q - i >= max(6, 4 * q):
                    out.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_collapse(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_runs_of_random_words():
    r = random.Random(5)
    for _ in range(250):
        docs = []
        for _ in range(r.randint(1, 12)):
            w, size = [], r.choice([0, 3, 20, 150])
            while len(w) < size:
                unit = r.choices("abc" if r.random() < 0.6 else "abcdefgh", k=r.randint(1, r.choice([2, 5, 12, 30])))
                w += unit * r.randint(1, 9) + (r.choices("ab", k=r.randint(1, 30)) if r.random() < 0.3 else [])
                if r.random() < 0.2:
                    w += w[: len(w) // 2] * 3
            docs.append(w[:600])
        codes, ends = periodic_runs.word_codes(pa.array([r.choice([" ", "\n "]).join(w) for w in docs]))
        got, first = periodic_runs.find_runs(codes, ends).tolist(), 0
        for w, end in zip(docs, ends.tolist(), strict=True):
            assert [(a - first, b - a, q) for a, b, q in got if first <= a < end] == plain_runs(w), w
            first = end


def test_fibonacci_words_and_long_periods():
    a, b = ["x"], ["x", "y"]
    while len(b) < 3000:
        a, b = b, b + a
    block = [f"w{i}" for i in range(700)]
    for words in (b, block * 4 + block[:300] + ["z"], ["q"] * 5000, ["p", "q"] * 900 + block * 5):
        codes, ends = periodic_runs.word_codes(pa.array([" ".join(words)]))
        assert [(s, e - s, q) for s, e, q in periodic_runs.find_runs(codes, ends).tolist()] == plain_runs(words)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_op12_equals_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, brute.FOLDER).collect()}
    docs, found = brute.documents(), 0
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        words = planted(i, SPACES.findall(text))
        runs = plain_runs(words)
        found += bool(runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        assert got[i] == (len(runs), *best, milli, sha(lines), sha(plain_collapse(words, runs))), i
    assert found > 5


def test_runs_odd_rows(spark):
    rows = {}
    for r in periodic_runs.periodic_runs(odd(spark)).collect():
        rows.setdefault(r.doc_id, []).append((len(r.runs), r.collapsed))
    want = {}
    for i, text, *_ in ODD:
        words = SPACES.findall(text or "")
        runs = plain_runs(words) if len(words) < 5000 else periodic_runs.find_runs(
            *periodic_runs.word_codes(pa.array([text])),
        ).tolist()
        stays = runs if len(words) < 5000 else [(s, e - s, q) for s, e, q in runs]
        want.setdefault(i, []).append((len(runs), plain_collapse(words, stays)))
    assert {i: sorted(x) for i, x in rows.items()} == {i: sorted(x) for i, x in want.items()}
    assert periodic_runs.periodic_runs(odd(spark, [])).count() == 0


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :]


def plain_variants(counts):
    out, form = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
        out[w] = n, len(near), counts[form[w]] if form[w] else None, form[w]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


@pytest.mark.parametrize("frame_words", [4096, 8])
def test_variants_of_random_words(spark, frame_words):
    r = random.Random(frame_words)
    counts = {"".join(r.choices("abé", k=r.randint(1, 9))): 2 * 10 ** r.randint(0, 6) for _ in range(900)}
    counts |= {"a" * k: 10**k for k in range(1, 12)}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {x.word: (x.n, x.n_near, x.form_n, x.form, x.root) for x in spelling.variants(words, 10, frame_words).collect()}
    assert got == plain_variants(counts)


def test_op13_equals_brute_force(spark):
    counts = Counter()
    for i, text in brute.documents().items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = run.translate(brute.UPPER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    rows = queries.QUERIES["op13_spelling_variants"](spark, brute.FOLDER).collect()
    got = {x.word: (x.n, x.n_near, x.form_n, x.form, x.root) for x in rows}
    assert len(rows) == len(counts) and got == plain_variants_fast(counts)
    assert sum(x.form is not None for x in rows) > 5


def plain_variants_fast(counts):
    """As ``plain_variants``, through the deletions of every word; pairs are compared letter by letter after."""
    holes = {}
    for w in counts:
        for k in range(len(w) + 1):
            holes.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    near = {w: set() for w in counts}
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    out, form = {}, {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
        out[w] = n, len(near[w]), counts[form[w]] if form[w] else None, form[w]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def test_spelling_odd_rows(spark):
    words = spelling.vocabulary(odd(spark), "a-zA-ZÀ-ÿ", 1, 1, queries.drop_letter)
    assert words.filter("word is null or n < 1").count() == 0
    assert words.count() == words.select("word").distinct().count()
    empty = spelling.vocabulary(odd(spark, []), "a-zA-ZÀ-ÿ", 1, 1)
    assert spelling.variants(empty).count() == 0
