from __future__ import annotations

import pyarrow.parquet as pq
from test_text_stages import brute_components, brute_leaks, split

import corpus_pipeline


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, small).persist()
        seen.append((name, before, docs.collect()))
        if name != "packing":
            assert docs.columns == columns
    (_, raw, good), (_, b2, one), (_, b3, cut), (_, b4, clean), (_, b5, pieces) = seen
    assert 0.7 * len(raw) < len(good) < len(raw)
    assert {r["doc_id"] for r in one} == {i for i, (_, c) in brute_components(b2.items()).items() if i == c}
    assert {r["doc_id"] for r in cut} == set(b3) and all(len(r["text"]) <= len(b3[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in cut)
    items = pq.read_table(f"{small}/benchmark.parquet").to_pydict()
    small_docs = {i: t for i, t in b4.items() if len(split(t)) < 400}
    leaks = brute_leaks(small_docs.items(), list(zip(items["item_id"], items["text"], strict=True)), 0.85)
    kept = {r["doc_id"] for r in clean}
    assert not kept & {d for d, _ in leaks} and len(kept) > 0.9 * len(b4)
    assert {r["doc_id"] for r in pieces} == set(b5)
    rows = corpus_pipeline.run(spark, small).collect()
    key = lambda rs: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rs)
    assert sum(r["length"] for r in rows) == sum(r["length"] for r in pieces) and len(key(rows)) > 0
