import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.sources import files, splitscan


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def odd_records(n=300, seed=3):
    r = random.Random(seed)
    parts = ['"', "\\", "}", "{", "[", "]", ",", "é", "中", "\n", "a b", '"}', "\\\\}", '},{"', "😀", " "]
    text = lambda k: "".join(r.choices(parts, k=k))
    return [
        {"text_id": f"Text #: {i}", "full_text": text(r.choice([0, 3, 40, 900])), "keywords": [text(3), text(2)], "position": i,
         "extra": {"a": [{"b": text(4)}, {}], "c": {}}}
        for i in range(n)
    ]


@pytest.mark.parametrize("form", ["list", "indented", "data", "data and more"])
def test_one_large_json_file_is_read_by_many_tasks(spark, tmp_path, small_ranges, form):
    records = odd_records()
    whole = records if form in ("list", "indented") else {"data": records}
    if form == "data and more":
        whole["version"] = 3
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(whole, ensure_ascii=False, indent=2 if form == "indented" else None), encoding="utf-8")
    got = {r.text_id: r for r in files.read_corpus_json(spark, str(path)).collect()}
    assert len(got) == len(records)
    for want in records:
        r = got[want["text_id"]]
        assert (r.full_text, r.keywords, r.position) == (want["full_text"], want["keywords"], want["position"])
    assert splitscan._fragments(spark, str(path), "}").rdd.getNumPartitions() > 20


def test_files_of_several_lists_and_empty_ones(spark, tmp_path, small_ranges):
    records = odd_records(90, 4)
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps(records[i::3]), encoding="utf-8")
    (tmp_path / "3.json").write_text(" [ ]\n")
    (tmp_path / "4.json").write_text('{"data": []}')
    (tmp_path / "5.json").write_text("")
    assert sorted(r.position for r in files.read_corpus_json(spark, str(tmp_path)).collect()) == list(range(90))


@pytest.mark.parametrize("broken", ['{"other": 1}', "[1, 2]", '[{"a": 1}, 2]', '[{"a": 1}', '[{"a": 1}, {"b"', '{"data": [{"a": 1}]', "text"])
def test_what_is_no_list_of_records_raises(spark, tmp_path, broken):
    (tmp_path / "a.json").write_text(broken)
    with pytest.raises(Exception, match="neither a list|MALFORMED_RECORD"):
        files.read_corpus_json(spark, str(tmp_path / "a.json")).collect()


def test_written_lists_come_back(spark, tmp_path, small_ranges):
    path = str(tmp_path / "lists")
    rows = spark.range(500).select(F.concat(F.lit("Text #: "), "id").alias("text_id"), F.repeat(F.lit('x"}'), 20).alias("full_text"))
    splitscan.write_json_lists(rows.repartition(3).unionByName(rows.limit(0)), path)
    back = files.read_corpus_json(spark, path)
    assert back.select("text_id", "full_text").exceptAll(rows).count() == 0 and back.count() == 500


@pytest.mark.parametrize("separator", ["\n", " "])
def test_a_large_text_file_comes_in_ranges(spark, tmp_path, small_ranges, separator):
    r = random.Random(9)
    words = ["é" * r.randint(1, 30) + "中😀x"[r.randint(0, 2)] for _ in range(3000)]
    (tmp_path / "big file.txt").write_text(separator.join(words), encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("erste\xff\nzweite".encode("latin-1"))
    (tmp_path / "empty.txt").write_text("")
    names = ["big file.txt", "b.txt", "empty.txt", "missing.txt"]
    manifest = spark.createDataFrame([(n, -i, n[:3]) for i, n in enumerate(names)], "file_name string, position int, label string")
    rows = splitscan.read_text_ranges(spark, str(tmp_path / "*.txt"), manifest, 300, separator).collect()
    ordered = sorted((x for x in rows if x.file_name == names[0]), key=lambda x: (x.block, x.part))
    assert separator.join(x.text for x in ordered) == separator.join(words)
    assert len({x.block for x in ordered}) > 5 and max(len(x.text) for x in ordered) <= 300
    assert [(x.position, x.label, x.text) for x in rows if x.file_name == "b.txt"] == [(-1, "b.t", "erste�\nzweite")]
    assert {x.file_name: x.text for x in rows if x.file_name in names[2:]} == {"empty.txt": None, "missing.txt": None}
