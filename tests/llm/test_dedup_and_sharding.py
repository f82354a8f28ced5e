import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.oracle import connect, differences
from textloom.llm import exact_dedup, near_dedup, queries, sharding, substring_dedup, suffix_bwt

ODD = [
    (1, "Same Text", "en"), (2, "same text", None), (2, "same text", None), (None, "same text", "en"), (3, None, "en"),
    (4, "", "en"), (5, "é" * 40_000, "fr"), (6, "ÀB", "fr"), (7, "àb", "fr"), (None, None, None),
]


def odd(spark, rows=ODD):
    """Nulls, empty and long texts, repeated rows, and columns that clash with internal and new ones."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return df.selectExpr("*", "doc_id AS _id", "text AS _text", "1 AS kept", "2 AS rep", "3 AS value", "4 AS n", "5 AS `_row`")


def native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_exact_dedup_equals_sql(spark):
    con = connect(brute.FOLDER)
    df = queries.QUERIES["op1_exact_dedup"](spark, brute.FOLDER)
    assert native(df) and differences(df, con, queries.ORACLES["op1_exact_dedup"]) == []


@pytest.mark.parametrize("parts", [exact_dedup.HOT_PARTS, 3])  # 3: the group of copies is spread over several runs
def test_exact_dedup_odd_rows(spark, monkeypatch, parts):
    monkeypatch.setattr(exact_dedup, "HOT_PARTS", parts)
    rows = [*ODD, *[(k, "Hot" * 20_000, "x") for k in range(100, 130)], (129, "hot" * 20_000, "y")]
    got = exact_dedup.mark_copies(odd(spark, rows), keep="largest").collect()
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        groups.setdefault(r.text_sha256, []).append(r)
    for text, ids in (("same text", [1, 2, 2, None]), ("", [3, 4, None]), ("hot" * 20_000, [*range(100, 130), 129])):
        own = groups[hashlib.sha256(text.encode()).hexdigest()]
        assert sorted(r.doc_id or -1 for r in own) == sorted(i or -1 for i in ids)
        best = max(i for i in ids if i is not None)
        assert {r.keep_id for r in own} == {best} and {r.group_size for r in own} == {len(ids)}
        assert [r.doc_id for r in own if r.kept] == [best]
    assert len([r for r in got if r.doc_id in (6, 7) and r.kept]) == 2  # only A-Z is lowered
    kept = exact_dedup.drop_copies(odd(spark, rows))
    assert kept.columns == odd(spark).columns and native(kept)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7, 100]


def test_exact_dedup_empty(spark):
    assert exact_dedup.mark_copies(odd(spark, [])).count() == 0 and exact_dedup.drop_copies(odd(spark, [])).count() == 0


def test_sharding_equals_sql_and_checksums(spark):
    con = connect(brute.FOLDER)
    df = queries.QUERIES["op2_histogram_sharding"](spark, brute.FOLDER)
    assert native(df) and differences(df.drop("text_crc32"), con, queries.OP2_SQL) == []
    docs = brute.documents()
    assert {r.doc_id: r.text_crc32 for r in df.collect()} == {i: zlib.crc32(t.encode()) for i, t in docs.items()}


@pytest.mark.parametrize("cell", [sharding.CELL_BYTES, 20_000])  # small cells: numbers run over many cells and parts
def test_sharding_balance_with_a_hot_text(spark, monkeypatch, cell):
    monkeypatch.setattr(sharding, "CELL_BYTES", cell)
    rows = [*[(k, "hot text " * 30, "x") for k in range(400)], *[(1000 + k, f"text {k} " * (k % 40), "x") for k in range(800)]]
    df = sharding.shard(odd(spark, rows), 8)
    got = df.collect()
    assert native(df) and len(got) == len(rows) and {"lang", "_id", "rep"} <= set(df.columns)
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_sharding_odd_rows(spark):
    got = sharding.shard(odd(spark), 3).collect()
    assert len(got) == len(ODD) and sorted(r["size"] for r in got if r.doc_id in (3, 4)) == [1, 1]
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(odd(spark, []), 3).count() == 0


@pytest.mark.parametrize("group", [suffix_bwt.GROUP, 8])
def test_suffix_order_equals_sorting(tmp_path, monkeypatch, group):
    monkeypatch.setattr(suffix_bwt, "GROUP", group)
    r = np.random.default_rng(5)
    for turn in range(60):
        words = [bytes(r.integers(0, r.choice([2, 5, 256]), r.integers(1, 14), dtype=np.uint8)) for _ in range(r.integers(1, 40))]
        size = np.array([len(w) for w in words])
        folder = tmp_path / str(turn)
        folder.mkdir()
        got = suffix_bwt.build(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size, str(folder))
        order = [words[i][len(words[i]) - n :] for i, n in zip(got.string, got.length, strict=True)]
        assert order == sorted(w[k:] for w in words for k in range(len(w)))
        for a, b, c in zip(order, order[1:], got.common[1:], strict=False):
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert same == c


def removed(df):
    return {
        r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()
    }


def test_suffix_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 50_000)
    monkeypatch.setattr(substring_dedup, "HASHED_BYTES", 20_000)
    got = queries.QUERIES["op3_suffix_dedup"](spark, brute.FOLDER).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeats(brute.documents())


def test_suffix_dedup_overlaps_and_runs(spark):
    r = np.random.default_rng(9)
    passage = bytes(r.integers(97, 101, 400, dtype=np.uint8)).decode()
    docs = {k: passage[r.integers(0, 200) :][: r.integers(40, 200)] * int(r.integers(1, 3)) + str(k) for k in range(60)}
    docs |= {100: "a" * 3000, 101: "a" * 49, 102: "b" + "a" * 50, 103: "é" * 60, 104: "x" + "é" * 60, 105: passage, 106: passage}
    assert removed(substring_dedup.remove_repeats(odd(spark, [(k, t, "") for k, t in docs.items()]))) == brute.repeats(docs)


def test_suffix_dedup_odd_rows(spark):
    text = "one passage that is long enough to be found again in another text"
    rows = [(1, text, ""), (1, "other " + text, ""), (2, text, ""), (2, text, ""), (None, text, ""), (3, None, ""), (4, "", "")]
    got = substring_dedup.remove_repeats(odd(spark, rows)).collect()
    left = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in got)
    n = len(text)
    assert left == sorted([(1, n, n), (1, n + 6, n + 6), (2, n, 0), (2, n, 0), (0, n, 0), (3, 0, 0), (4, 0, 0)])
    assert substring_dedup.remove_repeats(odd(spark, [])).count() == 0


def crowd():
    """A passage in every text, at a place and between words of its own, and some texts twice."""
    r = np.random.default_rng(12)
    word = lambda n: bytes(r.integers(97, 123, n, dtype=np.uint8)).decode()
    passage = " ".join(word(6) for _ in range(30))
    docs = {k: f"{word(int(r.integers(0, 90)))} {passage} {word(60)}" for k in range(400)}
    return docs | {400 + k: docs[k * 7] for k in range(20)}


def cut_in_packs(docs, packs, buckets, *hot):
    """Rows of the exchange by bucket, from several packs of texts."""
    rows = {}
    for k in range(packs):
        own = [i for i in docs if i % packs == k]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int64()), pa.array([0] * len(own), pa.int64()), pa.array([docs[i] for i in own])], ["_id", "_sub", "_text"]
        )
        for out in substring_dedup._cutter(50, buckets, *hot)(iter([batch])):
            for bucket, data in zip(out.column("bucket").to_pylist(), out.column("data").to_pylist(), strict=True):
                rows.setdefault(bucket, []).append(data)
    return rows


def strings(blobs):
    """Bytes and anchor of all strings of a bucket."""
    _, _, _, windows, anchor, data = substring_dedup._opened(blobs, 50)
    ends = np.cumsum(windows + 49)
    found = [data[e - w - 49 : e].tobytes() for e, w in zip(ends, windows, strict=True)]
    return found, [x[a : a + 16] for x, a in zip(found, anchor, strict=True)]


def test_suffix_dedup_sends_equal_segments_once():
    """Whatever the number of texts with a passage, a pack sends each of its segments once."""
    rows = cut_in_packs(crowd(), 3, 1)
    found, _ = strings(rows[0])
    assert max(Counter(found).values()) <= 3


def test_suffix_dedup_spreads_hot_anchors():
    """Segments that begin before the passage differ in every text but share its anchors."""
    docs = crowd()
    for_all = cut_in_packs(docs, 3, 16)
    _, anchors = zip(*[strings(b) for k, b in for_all.items() if k >= 0], strict=True)
    gram, n = Counter(x for a in anchors for x in a).most_common(1)[0]
    assert n > 300 and max(a.count(gram) for a in anchors) == n  # all in one bucket
    _, _, _, _, every = substring_dedup.segments(*substring_dedup.buffers(pa.array(list(docs.values()))), 50)
    rows = cut_in_packs(docs, 3, 16, np.unique(every))
    shares = [strings(b)[1].count(gram) for k, b in rows.items() if k >= 0]
    assert max(shares) < sum(shares) / 4
    ranges = {i: [] for i in docs}
    run = substring_dedup._finder(50)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([k for k in sorted(rows) for _ in rows[k]]), pa.array([x for k in sorted(rows) for x in rows[k]])], ["bucket", "data"]
    )
    for out in run(iter([batch])):
        for r in out.to_pylist():
            ranges[r["_id"]].append(r)
    want = brute.repeats(docs)
    for i, found in ranges.items():
        spans = substring_dedup.merged(found)
        assert (sum(b - a for a, b in spans), len(spans)) == want[i][1:3]


def test_suffix_dedup_compares_bytes_of_equal_hashes(monkeypatch):
    """Segments whose hashes collide are not taken for equal."""
    docs = {k: t for k, t in crowd().items() if k % 20 == 0}
    rows = cut_in_packs(docs, 2, 1)
    want = [c.tolist() for c in substring_dedup.repeated(rows[0], 50)]
    monkeypatch.setattr(substring_dedup, "prefix_hashes", lambda data, starts, *a, **k: [np.zeros(len(starts), np.uint64)])
    assert [c.tolist() for c in substring_dedup.repeated(rows[0], 50)] == want
    assert [sorted(x) for x in cut_in_packs(docs, 2, 1).values()] == [sorted(x) for x in rows.values()]


def test_suffix_dedup_of_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 4_000)  # many anchors are hot
    docs = crowd()
    assert removed(substring_dedup.remove_repeats(odd(spark, [(k, t, "") for k, t in docs.items()]))) == brute.repeats(docs)


def test_near_duplicates_equal_brute_force(spark):
    got = queries.QUERIES["op10_minhash_near_dedup"](spark, brute.FOLDER).collect()
    want = brute.near(brute.documents())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_crowded_lists(spark):
    """A passage many share, and copies with more and more changes: chains, and groups that must stay apart."""
    r = np.random.default_rng(4)
    base = [f"w{k}" for k in r.integers(0, 10_000, 300)]
    docs = {}
    for k in range(40):
        own = list(base)
        for at in r.choice(300, int(r.integers(0, 14)), replace=False):
            own[at] = f"x{k}-{at}"
        docs[k] = " ".join(own)
    for k in range(100, 140):
        docs[k] = " ".join([f"y{k}-{j}" for j in range(int(r.integers(10, 80)))] + base[:60])
    docs |= {200: "short text", 201: "Short\ttext", 202: "short  text now", 203: " \n", 204: ""}
    got = near_dedup.near_duplicates(odd(spark, [(k, t, "") for k, t in docs.items()])).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute.near(docs)


def test_near_duplicates_odd_rows(spark):
    got = near_dedup.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD)
    same = [r for r in got if r.component_id == 1]
    assert len(same) == 4 and [r.doc_id for r in same if r.kept] == [1]
    assert all(r.kept and r.n_shingles == 0 for r in got if r.doc_id in (3, 4))
    kept = near_dedup.drop_near_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7]
    assert near_dedup.near_duplicates(odd(spark, [])).count() == 0
    assert near_dedup.drop_near_duplicates(odd(spark, [])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 30)]
    got = near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    want = {k: 100 for k in range(100, 141)} | {k: 1 for k in range(1, 30)}
    assert {r.node: r.root for r in got.collect()} == want
    assert got.select(F.countDistinct("node")).first()[0] == got.count()
