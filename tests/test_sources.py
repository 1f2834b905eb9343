from __future__ import annotations

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftgraph.functions.embedding import hashing_embedder
from weftgraph.sources import corpus, knowledge, session_logs


def test_folder_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"article_number": 1, "title": "x", "content": ["p", "q"], "keywords": ["k"]}, {"article_number": 2, "content": {"a": "b"}}]))
    (tmp_path / "b.json").write_text(json.dumps({"other": 1}))
    (tmp_path / "community_reports.json").write_text(json.dumps([{"id": "r1", "article_number": 9}]))
    rows = corpus.scan_folder(spark, str(tmp_path)).select("article_number", F.to_json("content").alias("c")).orderBy("article_number").collect()
    assert [tuple(r) for r in rows] == [(1, '["p","q"]'), (2, '{"a":"b"}')]
    assert corpus.scan_file(spark, str(tmp_path / "a.json")).count() == 2


def test_reports(spark, tmp_path):
    assert corpus.scan_reports(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "r.json").write_text(json.dumps([{"id": "b", "level": 1}, {"id": "a", "level": 1, "findings": ["x"]}]))
    assert [r["id"] for r in corpus.export_reports(corpus.scan_reports(spark, str(tmp_path / "r.json"))).collect()] == ["a", "b"]


def test_append_and_clear(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.5, 0.5])], "id int, vector array<double>")
    path = str(tmp_path / "t")
    corpus.append(rows, path)
    corpus.append(rows, path)
    assert spark.read.parquet(path).count() == 2
    assert corpus.vector_length(spark.read.parquet(path), "vector") == 2
    corpus.clear(rows, path)
    assert spark.read.parquet(path).count() == 0


def test_fingerprints(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert tuple(corpus.file_fingerprints(spark, str(tmp_path)).first()) == ("f.bin", 3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")


def record(session, seq, kind="query"):
    return json.dumps({"session_id": session, "seq": seq, "kind": kind, "content": "c"})


def test_strict_logs(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text(record("s1", 0) + "\n" + record("s1", 1) + "\n")
    assert session_logs.scan_log_strict(spark, str(tmp_path)).count() == 2


@pytest.mark.parametrize("text", ["", record("s1", 0), "not json\n", record("other", 0) + "\n"])
def test_broken_logs_fail(spark, tmp_path, text):
    (tmp_path / "s1.jsonl").write_text(text)
    with pytest.raises((PySparkException, ValueError)):
        session_logs.scan_log_strict(spark, str(tmp_path / "s1.jsonl")).collect()


def test_index_read_twice_fails(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps([{"session_id": "a"}, {"session_id": "a"}]))
    with pytest.raises(PySparkException):
        session_logs.read_index(spark, str(tmp_path / "i.json")).collect()


def test_events(spark):
    text = ": hi\nevent: token\ndata: a\ndata: b\n\n\nevent: done\ndata: {}\n\n"
    rows = session_logs.parse_events(spark.createDataFrame([(1, text)], "id int, t string"), "id", F.col("t")).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "token", "a\nb"), (1, 1, "done", "{}")]
    with pytest.raises(PySparkException):
        session_logs.parse_events(spark.createDataFrame([(1, "event: odd\n\n")], "id int, t string"), "id", F.col("t")).collect()


def test_replace_file(spark, tmp_path):
    path = tmp_path / "manifest.json"
    for text in ("{}", '{"model": "é"}'):
        corpus.replace_file(spark, str(path), text)
        assert path.read_text(encoding="utf-8") == text


def test_folders_fail_on_broken_files_and_skip_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"article_number": 1, "title": "t"}, {"article_number": 2, "metadata": {"part": "p"}}]))
    (tmp_path / "b.json").write_text(json.dumps({"article_number": 3}))
    (tmp_path / "community_reports.json").write_text(json.dumps([{"article_number": 4}]))
    assert sorted(r["article_number"] for r in corpus.scan_folder(spark, str(tmp_path)).collect()) == [1, 2]
    (tmp_path / "c.json").write_text('[{"article_number": 5}')
    with pytest.raises((PySparkException, Py4JJavaError)):
        corpus.scan_folder(spark, str(tmp_path)).collect()


def test_upload_is_incremental_and_refused_by_a_manifest(spark, tmp_path):
    store, embed = f"file://{tmp_path}/store", hashing_embedder(8)
    first = json.dumps([{"article_number": 1, "title": "a", "content": "1. x\n2. theo Điều 2"}, {"article_number": 2, "title": "b", "content": "y"}])
    stats = lambda rows: {r["key"]: r["n"] for r in rows.collect() if r["n"]}
    one = {"Article": 2, "Clause": 3, "edge:HAS_CLAUSE": 3, "edge:REFERENCES": 1, "edge:REFERENCED_BY": 1, "edge:NEXT_ARTICLE": 1}
    for _ in range(2):
        assert stats(knowledge.upload(spark, store, "a.json", first, embed)) == one
    assert spark.read.parquet(f"{store}/vectors").count() == spark.read.parquet(f"{store}/progress").count() == 5
    more = json.dumps([{"article_number": 3, "title": "c", "content": "theo Điều 1"}])
    assert stats(knowledge.upload(spark, store, "b.json", more, embed)) == one | {"Article": 3, "Clause": 4, "edge:HAS_CLAUSE": 4, "edge:REFERENCES": 2, "edge:REFERENCED_BY": 2}
    corpus.replace_file(spark, f"{store}/{knowledge.MANIFEST}", "{}")
    with pytest.raises(knowledge.StoreLocked):
        knowledge.upload(spark, store, "c.json", more, embed)
    assert not (tmp_path / "store/files/c.json").exists()


def test_resume_refuses_unknown_progress(spark):
    rows = spark.createDataFrame([("article", "1", 0), ("article", "2", 0), ("clause", "1", 0)], "kind string, id string, v int")
    stored = rows.where("id = '1' and kind = 'article'")
    assert sorted((r["kind"], r["id"]) for r in knowledge.resumed(rows, stored, stored.limit(0)).collect()) == [("article", "2"), ("clause", "1")]
    with pytest.raises(knowledge.ProgressAhead, match="lists 2 ids .*first: 2"):
        knowledge.resumed(rows, stored, rows)


def test_tables_of_a_folder(spark, small):
    rows = {(r["table"], r["column"]): (r["type"], r["vector_length"]) for r in corpus.table_catalog(spark, small).collect()}
    assert rows["embeddings", "embedding"] == ("array<float>", 64) and rows["documents", "doc_id"][0] == "bigint" and rows["documents", "text"] == ("string", None)
    assert len({t for t, _ in rows}) >= 14


def test_broken_files_fail(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"article_number": 1, "title": "x"}, {"article_number":')
    with pytest.raises(Exception, match="(?i)malformed"):
        corpus.scan_file(spark, str(tmp_path / "a.json")).collect()
