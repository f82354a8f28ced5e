import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.test_dedup_and_sharding import ODD, odd
from textloom.llm import ann, packing, queries, sentencepieces, tokens
from textloom.llm.bpe import Encoder
from textloom.llm.common import new_folder

LETTERS = "aB é'’sdtlrevm   \n\t\r 0123.,!?-ßÄöΣσς́　　中文字😀\x1c\x1f\x85\x00²½ⅷİ▁ﬁthe"


def mixed(n=3000):
    r = random.Random(6)
    texts = ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 50))) for _ in range(n)]
    return [*texts, "", " ", "  a", "a  ", "a\n b", "<|endoftext|> a <s>", "x" * 3000, "a" + " " * 40 + "b", "İ. İs"]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    texts = [*mixed(), *brute.documents().values()]
    encoder = Encoder(public_tokenizers.path(name), most_known=500)  # a small table is emptied often
    want = library(name).encode_batch(texts, add_special_tokens=False)
    for text, ids in zip(texts, want, strict=True):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids.ids, text
    found, ends = encoder.encode_all(pa.array(texts), [7, 8])
    assert found.tolist() == [i for x in want for i in [*x.ids, 7, 8]]
    assert np.diff(ends, prepend=0).tolist() == [len(x.ids) + 2 for x in want]


def test_token_files_equal_library(spark):
    got = sorted(tuple(r) for r in queries.QUERIES["op4_token_files"](spark, brute.FOLDER).collect())
    t, at, want = library("byte_bpe_50k.json"), 0, []
    for i, text in sorted(brute.documents().items()):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert got == want


def test_token_files_odd_rows_and_selective_read(spark):
    path = new_folder(spark, "tokens")
    tokens.write_tokens(odd(spark), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    files = spark.read.parquet(path)
    assert files.columns == ["doc_id", "n_tokens", "ids"] and files.count() == len(ODD)
    rows = tokens.read_tokens(spark, path).collect()
    ends = sorted((r.start, r.start + r.n_tokens) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    assert files.filter("doc_id = 4").first().ids == [2]
    plan = files.filter("doc_id = 4").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,4)" in plan and "ids" not in plan.split("ReadSchema")[1]
    empty = new_folder(spark, "tokens")
    tokens.write_tokens(odd(spark, []), empty, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert tokens.read_tokens(spark, empty, with_crc=True).count() == 0


def test_sentencepiece_equals_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.Pieces(path)
    texts = [*mixed(), *brute.documents().values(), *[" " * k for k in range(70)], "a" + " " * 700 + "1"]
    ids = [np.frombuffer(x, "<u4") for at in range(0, len(texts), 400) for x in own.encode(texts[at : at + 400])]
    assert [x.tolist() for x in ids] == model.encode(texts)
    assert [own.decode(x) for x in ids] == [t.replace("▁", " ") for t in texts]


def test_few_piece_lengths_are_tried_per_character():
    own = sentencepieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert sum(map(len, own.sizes.values())) / len(own.sizes) < 4
    assert all({n for n in range(3, 20) if any(len(p) == n and p.endswith(e) for p in own.real)} <= set(own.sizes[e]) for e in ["ing", "▁th", "ion"])


def test_sentencepiece_query_and_odd_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = brute.documents()
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op8_sentencepiece"](spark, brute.FOLDER).collect()}
    assert got == {i: (len(x), brute.crc(x)) for i, x in ((i, model.encode(t)) for i, t in docs.items())}
    back = sentencepieces.decode(sentencepieces.encode(odd(spark), path), path).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, _ in ODD)
    assert sentencepieces.encode(odd(spark, []), path).count() == 0


def test_packing_query(spark):
    t, want = library("word_bpe_49k.json"), {}
    for i, text in brute.documents().items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096] = (k, len(ids[k : k + 4096]), brute.crc(ids[k : k + 4096]))
    got = queries.QUERIES["op6_best_fit_packing"](spark, brute.FOLDER).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    assert check_sequences(got, 4096) == -(-sum(r.length for r in got) // 4096)


def check_sequences(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and sum(own[-1]) <= capacity
        assert all(sum(a) == b[0] for a, b in zip(own, own[1:], strict=False))
    return len(bins)


def test_partitions_with_gaps_exchange(spark):
    r = np.random.default_rng(3)
    sizes = [int(x) for x in r.integers(30, 61, 600)]  # hard: two or three of a size to a sequence
    df = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "doc_id long, length long")
    alone = check_sequences(packing.pack(df, 100, group_rows=10_000).collect(), 100)
    dealt = packing.pack(df, 100, group_rows=60).collect()
    assert sorted(x.doc_id for x in dealt) == list(range(600))
    assert packing.lower_bound(np.array(sizes), 100) <= alone <= check_sequences(dealt, 100) <= 1.05 * alone


def test_exchange_ends_when_a_round_saves_nothing(spark, monkeypatch, caplog):
    """Two to four of such sizes fill a sequence: rounds beyond the fourth still save some."""
    sizes = [int(x) for x in np.random.default_rng(3).integers(200, 500, 2000)]
    rounds, store = [], packing.store
    monkeypatch.setattr(packing, "store", lambda df, name: (rounds.append(name), store(df, name))[1])
    df = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "doc_id long, length long").coalesce(1)
    rows = packing.pack(df, 1000, group_rows=40).collect()
    check_sequences(rows, 1000)
    assert sorted(x.doc_id for x in rows) == list(range(2000))
    assert rounds.count("packed") > 4 and "above the bounds" in caplog.text


def test_lower_bound_and_best_fit_against_search():
    r = np.random.default_rng(8)

    def fewest(sizes, room=()):
        if not sizes:
            return len(room)
        options = {x for x in room if x >= sizes[0]}
        tries = [fewest(sizes[1:], [*(y for j, y in enumerate(room) if j != room.index(x)), x - sizes[0]]) for x in options]
        return min([*tries, fewest(sizes[1:], [*room, 10 - sizes[0]])])

    for _ in range(60):
        sizes = np.sort(r.integers(1, 11, 6))[::-1]
        best = fewest(sizes.tolist(), [])
        bins, offsets, room = packing.best_fit(sizes, 10)
        assert packing.lower_bound(sizes, 10) <= best <= len(room)
        for b in range(len(room)):
            assert room[b] == 10 - sizes[bins == b].sum() >= 0
            assert sorted(offsets[bins == b]) == [0, *np.cumsum(sizes[bins == b])[:-1]]


def test_packing_odd_rows(spark):
    cut = packing.pieces(odd(spark), public_tokenizers.path("word_bpe_49k.json"), 1, 64)
    rows = packing.pack(cut, 64).collect()
    assert len([r for r in rows if r.doc_id in (3, 4)]) == 2 and check_sequences(rows, 64)
    assert all(len(r.ids) == r.length and r.ids_crc32 == brute.crc(r.ids) for r in rows)
    assert packing.pack(packing.pieces(odd(spark, []), public_tokenizers.path("word_bpe_49k.json"), 1, 64), 64).count() == 0
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(spark.createDataFrame([(65,)], "length long"), 64).count()


def exact_nearest(ids, x, queries_, k):
    n = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries_:
        at = list(ids).index(q)
        c = (x * x[at]).sum(1) / (n * n[at])
        order = sorted((i for i in range(len(ids)) if i != at), key=lambda i: (-round(c[i], 13), ids[i]))[:k]
        out[q] = [(ids[i], c[i]) for i in order]
    return out


def test_nearest_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{brute.FOLDER}/../sf0.01/embeddings.parquet' ORDER BY 1").fetchall()
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], float)
    want = exact_nearest(ids, x, [i for i in ids if i % 50 == 0], 5)
    got = queries.QUERIES["op5_posting_lists"](spark, f"{brute.FOLDER}/../sf0.01").collect()
    found = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want}
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    scores = {q: {ids[i]: c for i, c in enumerate((x * x[ids.index(q)]).sum(1) / np.sqrt((x * x).sum(1)) / np.sqrt((x[ids.index(q)] ** 2).sum()))} for q in want}
    assert all(abs(s - scores[q][v]) < 1e-12 for q, own in found.items() for v, s in own)


def test_nearest_copies_ties_and_bad_vectors(spark):
    rows = [(k, [1.0, 2.0, 0.0]) for k in range(0, 60, 3)] + [(200, [2.0, 4.0, 0.0]), (201, [0.0, 0.0, 1e-300]), (202, [-0.0, 0.0, 3.0])]
    bad = [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, None, 0.0]), (303, [float("nan"), 0.0, 1.0]), (304, [float("inf"), 0.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([*rows, *bad, rows[0]], "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS list", "3 AS entry")
    got = ann.nearest(df, df.filter("vec_id in (0, 6, 201, 300, 302)"), 5).collect()
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    assert found[0] == [3, 6, 9, 12, 15] and found[6] == [0, 3, 9, 12, 15] and found[201][0] == 202 and set(found) == {0, 6, 201}
    one = ann.nearest(df.filter("vec_id in (0, 201)"), df.filter("vec_id = 0"), 5).collect()
    assert [(r.vec_id, r["rank"], r.score) for r in one] == [(201, 1, 0.0)]
    assert ann.nearest(df.limit(0), df.limit(0), 5).count() == 0
    with pytest.raises(ValueError, match="values"):
        ann.nearest(df.union(df.limit(1).selectExpr("900", "array(1D)", "1", "2", "3")), df, 5)
