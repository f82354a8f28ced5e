import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_dedup_and_sharding import ODD, odd
from tests.llm.test_tokens_and_search import check_sequences
from textloom.llm import pii, queries, toxicity


def test_patterns_equal_plain_regexes():
    r = random.Random(2)
    for letters in ("a.@b-c+_1", "0123456789.. -+()", "ab@.1 9é\n"):
        for _ in range(8000):
            text = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
            assert [(a, b, pii.KINDS[k]) for a, b, k in pii.base_spans(text)] == brute.spans(text), text


def test_pii_query_equals_brute_force(spark):
    docs = brute.documents()
    for r in queries.QUERIES["op7_pii"](spark, brute.FOLDER).collect():
        want = brute.spans(docs[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, _, k in want) for x in pii.KINDS]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_tagger_gradient():
    model, r = pii.Tagger.new(), np.random.default_rng(1)
    x, y = r.integers(0, 40, (3, 12)), r.integers(0, pii.TAGS, (3, 12))
    _, grads = model.gradient(x, y)
    for name, at in (("E", (x[0, 3], 2)), ("Wf", (1, 5)), ("Ub", (2, 9)), ("bf", (20,)), ("V", (3, 2)), ("T", (1, 2)), ("c", (1,))):
        values = []
        for step in (1e-5, -1e-5):
            moved = pii.Tagger({k: v.copy() for k, v in model.p.items()})
            moved.p[name][at] += step
            values.append(moved.gradient(x, y)[0])
        assert abs((values[0] - values[1]) / 2e-5 - grads[name][at]) < 1e-5


def test_tagger_on_held_out_texts():
    texts = [t for t in brute.documents(f"{brute.FOLDER}/../sf0.1").values() if pii.TRIGGER.search(t)]
    model = pii.train(texts[::2])
    held = texts[1::2]
    base = [pii.base_spans(t) for t in held]
    found = pii.added_spans(model, held, [[] for _ in held])
    right = sum(len(set(f) & set(b)) for f, b in zip(found, base, strict=True))
    assert right >= 0.9 * sum(map(len, found)) and right >= 0.4 * sum(map(len, base))
    assert not any(set(a) & set(b) for a, b in zip(pii.added_spans(model, held, base), base, strict=True))


def test_best_path_equals_enumeration():
    r = np.random.default_rng(4)
    model = pii.Tagger.new()
    model.p["T"] = r.normal(0, 1, (pii.TAGS, pii.TAGS))
    e = r.normal(0, 1, (5, 4, pii.TAGS))
    every = np.array(list(itertools.product(range(pii.TAGS), repeat=4)))
    steps = model.p["T"][every[:, :-1], every[:, 1:]].sum(1)
    marginals = model.marginals(e)
    for row, path, m in zip(e, model.best_path(e), marginals, strict=True):
        scores = row[np.arange(4), every].sum(1) + steps
        assert path.tolist() == every[scores.argmax()].tolist()
        weight = np.exp(scores) / np.exp(scores).sum()
        assert np.allclose([[weight[every[:, k] == t].sum() for t in range(pii.TAGS)] for k in range(4)], m)


PHONES = [f"+{c} ({a}) 555-{n}" for c, a, n in zip((1, 44, 353), (415, 212, 871), (2671, 1943, 8826), strict=True)]
MAILS = ["ann.lee@mail.example.com", "bo_kim77@data.example.org", "c.d.eberhart@post.example.net"]


def mixed(seed: int) -> str:
    """Personal data so dense that one stretch holds all of it."""
    r = random.Random(seed)
    words = "call mail or then ask for us at the desk before noon".split()
    parts = [r.choice([r.choice(PHONES), r.choice(MAILS), " ".join(r.choices(words, k=2))]) for _ in range(r.randint(6, 14))]
    return " ".join(["call", r.choice(PHONES), *parts, r.choice(MAILS), "now"])


@pytest.fixture(scope="module")
def tagger():
    return pii.train([mixed(i) for i in range(120)])


def test_overlapping_windows_agree_with_one(tagger, monkeypatch):
    texts = [mixed(i) for i in range(1000, 1040)]
    several = pii.added_spans(tagger, texts, [[] for _ in texts])
    base = [pii.base_spans(t) for t in texts]
    assert any(len(pii._windows(*s)) > 3 for t in texts for s in pii._stretches(t))
    monkeypatch.setattr(pii, "WIDTH", 4096)
    monkeypatch.setattr(pii, "STRIDE", 2048)
    one = pii.added_spans(tagger, texts, [[] for _ in texts])
    assert all(len(pii._windows(*s)) == 1 for t in texts for s in pii._stretches(t))
    found = sum(map(len, one))
    assert found >= 0.6 * sum(map(len, base))
    assert sum(len(set(a) & set(b)) for a, b in zip(one, several, strict=True)) >= 0.95 * found
    assert sum(len(set(a) & set(b)) for a, b in zip(several, base, strict=True)) >= 0.95 * sum(map(len, several))


def test_long_stretches_and_batches(tagger, monkeypatch):
    """Blocks and batches change no span in their inside; every span is found once."""
    text = " ".join(mixed(i) for i in range(12))
    (whole,) = pii.added_spans(tagger, [text], [[]])
    monkeypatch.setattr(pii, "BLOCK", 300)
    (cut,) = pii.added_spans(tagger, [text], [[]])
    assert len(set(cut)) == len(cut) and len(set(cut) & set(whole)) >= 0.95 * len(whole) > 0
    many = [mixed(i) for i in range(200, 400)] + ["", "no trigger", "7"]
    together = pii.added_spans(tagger, many, [[] for _ in many])
    assert together == [pii.added_spans(tagger, [t], [[]])[0] for t in many]


def test_stitched_emissions_lie_between_the_middles_of_overlaps():
    windows = pii._windows(10, 10 + 2 * pii.WIDTH + 7)
    e = np.zeros((len(windows), pii.WIDTH, 2))
    for k, (a, b) in enumerate(windows):
        e[k, :, 0], e[k, : b - a, 1] = k, np.arange(a, b)
    got = pii.stitched(e, windows)
    assert got[:, 1].tolist() == list(range(10, 10 + 2 * pii.WIDTH + 7))
    for k, place in got.astype(int):
        depth = [min(place - a, b - 1 - place) for a, b in windows]
        assert max(depth) <= depth[k] + 1 or place - windows[0][0] < pii.STRIDE or windows[-1][1] - place <= pii.WIDTH


def test_rewritten_spans():
    text = f"4 {PHONES[0]} and {MAILS[0]}; 10.0.0.17, 4111 1111 1111 1111 end +44 20 7946 0"
    spans = pii.base_spans(text)
    kinds = {k for _, _, k in spans}
    assert kinds == {0, 1, 2, 3}
    for turn in range(30):
        other, own = pii.rewritten(text, spans, turn)
        assert [k for _, _, k in own] == [k for _, _, k in spans] and other != text
        keep = lambda t: re.sub("[^0-9a-z@]", "", t)
        for (a, b, k), (c, d, _) in zip(spans, own, strict=True):
            new, old = keep(other[c:d]), keep(text[a:b])
            assert new == old or (k == 3 and (old.endswith(new) or new == "00" + old))
        assert [other[a:b] for a, b in zip([0, *(e for _, e, _ in own)], [*(s for s, _, _ in own), len(other)])] == [
            text[a:b] for a, b in zip([0, *(e for _, e, _ in spans)], [*(s for s, _, _ in spans), len(text)])
        ]
    assert pii.rewritten("ab", [], 0) is None and pii.rewritten("12 34", [(-3, 2, 3)], 0) is None
    assert pii.tags(6, [(-3, 2, 3), (4, 9, 0)]).tolist() == [8, 8, 0, 0, 1, 2]


def test_tagger_finds_forms_the_patterns_miss():
    texts = [t for t in brute.documents(f"{brute.FOLDER}/../sf0.1").values() if pii.TRIGGER.search(t)]
    model = pii.train(texts[::2])
    rows = [r for k, t in enumerate(texts[1::2]) if (r := pii.rewritten(t, pii.base_spans(t), k))]
    base = [pii.base_spans(t) for t, _ in rows]
    found = pii.added_spans(model, [t for t, _ in rows], base)
    missed = [{s for s in own if not any(a < s[1] and s[0] < e for a, e, _ in b)} for (_, own), b in zip(rows, base, strict=True)]
    right = sum(len(set(f) & m) for f, m in zip(found, missed, strict=True))
    assert right >= 0.9 * sum(map(len, found)) and right >= 0.4 * sum(map(len, missed))


def test_pii_odd_rows(spark):
    rows = [*ODD, (20, "a@b.co and 1.2.3.4", "en"), (21, "1" * 50_000, "en")]
    masked = pii.mask(odd(spark, rows), None)
    got = {r.doc_id: r for r in masked.collect() if r.doc_id}
    assert masked.columns == [*odd(spark).columns, "spans"]
    assert got[20].text == "<email> and <ip>" and got[3].text is None and got[4].text == "" and got[21].spans == []
    assert pii.find(odd(spark, []), None).count() == 0 and pii.train([]) is None
    assert pii.masked("abcdef", [(0, 3, 0), (2, 4, 1), (5, 6, 2)]) == "<email>e<card>"


def test_toxicity_on_held_out_documents(spark):
    folder = f"{brute.FOLDER}/../sf0.1"
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    got = queries.QUERIES["op9_toxicity"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    hit = sum(r.predicted and labels[r.doc_id] for r in held)
    assert hit >= 0.9 * sum(labels[r.doc_id] for r in held) and hit >= 0.9 * sum(r.predicted for r in held)


def test_toxicity_finds_the_sentence(spark):
    r = random.Random(3)
    words = "the sea is calm today we walk home birds sing over old stone walls near green hills".split()
    sentence = lambda *more: " ".join(r.sample([*r.choices(words, k=5), *more], 5 + len(more)))
    clean = [f"{sentence()}. {sentence()}! {sentence()}." for _ in range(400)]
    bad = [f"{sentence()}. {sentence('zorgblat')}! {sentence()}." for _ in range(100)]
    model = toxicity.fit(pa.array(clean + bad), np.array([0] * 400 + [1] * 100))
    rows = [*ODD, (30, "Ünder the sea. A zorgblat walks here. Home.", "en")]
    got = {r.doc_id: r for r in toxicity.score(odd(spark, rows), model).collect() if r.doc_id}
    assert got[30].score >= toxicity.REJECT and got[3].score == got[4].score == 0 and got[7].score < toxicity.REJECT
    (found,) = got[30].offending
    assert rows[-1][1][found.start : found.end] == "A zorgblat walks here"
    assert toxicity.score(odd(spark, []), model).count() == 0


@pytest.mark.parametrize("labels", [[], [0, 0, 0], [1, 1, 1]])
def test_toxicity_without_both_labels(labels):
    model = toxicity.fit(pa.array(["one", "", "two three"][: len(labels)], pa.string()), np.array(labels, np.int64))
    assert len(model.keys) == 0


def test_sample_is_bounded_and_leaves_out_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_PER_CLASS", {1: 2, 0: 5})
    docs, labels = queries.table(spark, brute.FOLDER, "documents"), queries.table(spark, brute.FOLDER, "labels")
    texts, y = toxicity.fitting_sample(docs, labels, "toxic", ~queries.held_out("doc_id"))
    allowed = {t for i, t in brute.documents().items() if zlib.crc32(str(i).encode()) % 4 != 2}
    assert 0 < sum(y) <= 4 and 0 < len(y) - sum(y) <= 10 and set(texts.to_pylist()) <= allowed


def test_pipeline_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{brute.FOLDER}/documents.parquet")
    texts, columns = brute.documents(), docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "minhash_near_dedup", "pii", "best_fit_packing"]
    scores = {r.doc_id: r.predicted for r in queries.QUERIES["op9_toxicity"](spark, brute.FOLDER).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, brute.FOLDER), name)
        got = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and len(got) == docs.count()
        if name == "toxicity":
            texts = {i: t for i, t in texts.items() if not scores[i]}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(texts):
                first.setdefault(texts[i].translate(brute.UPPER), i)
            texts = {i: texts[i] for i in first.values()}
        elif name == "minhash_near_dedup":
            texts = {i: texts[i] for i, (_, root) in brute.near(texts).items() if i == root}
        else:
            left = {i: brute.spans(r.text) for i, r in got.items()}
            assert not any(left.values()) and set(got) == set(texts)
            assert all(r.n_chars == len(r.text) for r in got.values())
            same = {i: t for i, t in texts.items() if not pii.TRIGGER.search(t)}
            texts = same | {i: r.text for i, r in got.items() if i not in same}
        assert {i: r.text or "" for i, r in got.items()} == texts
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, brute.FOLDER).collect()
    assert {r.doc_id for r in packed} == set(texts) and check_sequences(packed, queries.SEQUENCE)
