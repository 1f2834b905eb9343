"""Figures that the README states, SQL on the small corpus, and odd tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import decontamination, jaccard_join, lm_scoring, packing, suffix_dedup, token_files
from weftgraph.llm.common import shared_folder
from weftgraph.llm.queries import OP2_SQL, OP5_SQL
from weftgraph.llm.shingles import mixed

WORDS = P.path("word_bpe_49k.json")


def test_recall_at_the_threshold(spark):
    """400 items of 40 words, each held with one word changed: similarity 31 / 41."""
    rng = np.random.default_rng(11)
    prose = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    items, rows = [], []
    for i in range(400):
        w = prose(40)
        items.append((i, " ".join(w)))
        w[int(rng.integers(4, 36))] = "changed"
        rows.append((i, " ".join([*prose(30), *w, *prose(30)])))
    found = decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {round(r["similarity"], 9) for r in found} == {round(31 / 41, 9)}
    assert len([r for r in found if r["doc_id"] == r["item_id"]]) >= 0.985 * len(items)


def test_leaks_of_odd_rows(spark):
    item = "one two three four five six seven"
    rows = spark.createDataFrame([(None, item, "x"), (1, f"a {item} b", "y"), (1, f"a {item} b", "y"), (2, None, None), (3, "", "z")], "doc_id long, text string, item_id string").withColumn("similarity", F.lit("own"))
    bench = spark.createDataFrame([(7, item), (8, item), (None, item), (9, None)], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["item_id"] or 0) for r in decontamination.find_leaks(rows, bench).collect()))
    assert got == sorted([(d, i) for d in (0, 1, 1) for i in (0, 7, 8)])
    kept = decontamination.drop_leaks(rows, bench)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == {2, 3}


@pytest.mark.parametrize("name", ["op2", "op5"])
def test_sql_of_the_small_corpus(docs, corpus, name):
    con = duckdb.connect()
    table = pd.DataFrame(corpus, columns=["doc_id", "text"])
    con.register("rows", table)
    con.execute("create table documents as select doc_id, cast(text as varchar) as text from rows")
    df, sql = (jaccard_join.jaccard_components(docs), OP2_SQL) if name == "op2" else (suffix_dedup.repeated_bytes(docs), OP5_SQL)
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(tuple(r[n] for n in names) for r in df.select(names).collect()) == sorted(found.fetchall())


def test_footers_of_token_files(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("some words "), 20), F.col("id").cast("string")).alias("text"))
    token_files.write_token_files(rows, path, WORDS, files=2)
    parts = sorted((tmp_path / "ids").glob("*.parquet"))
    assert len(parts) == 2
    for part in parts:
        meta = pq.ParquetFile(part).metadata
        at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
        ids, counts, key = (next(i for p, i in at.items() if p.startswith(c)) for c in ("ids", "n_tokens", "doc_id"))
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 2 * token_files.ROW_GROUP_BYTES
            assert "RLE_DICTIONARY" in group.column(ids).encodings and group.column(ids).dictionary_page_offset
            assert all("DELTA_BINARY_PACKED" in group.column(c).encodings for c in (counts, key))
            assert all(group.column(c).has_offset_index and group.column(c).has_column_index for c in (counts, key))
            assert group.column(counts).total_compressed_size < group.column(ids).total_compressed_size
    plan = spark.read.parquet(path).where("doc_id = 17").select("n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,17)" in plan and "ids" not in plan.split("ReadSchema")[1]


ODD = [(None, "a b"), (1, "a b"), (1, "a b"), (1, "a"), (2, None), (3, "")]


def test_token_files_of_odd_rows(spark):
    path = shared_folder(spark, "ids")
    rows = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"ids": F.lit("own"), "part": F.lit(5)})
    token_files.write_token_files(rows, path, WORDS)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.digests(token_files.read_token_files(spark, path)).collect()))
    assert [d for _, d, _ in got] == [None, 1, 1, 1, 2, 3] and [n for *_, n in got][4:] == [1, 1]
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_packing_of_odd_rows(spark, none):
    assert packing.pack(none, WORDS).count() == 0
    rows = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"offset": F.lit("own"), "length": F.lit(5)})
    got = packing.pack(rows, WORDS, size=4).collect()
    total = {d: sum(r["length"] for r in got if r["doc_id"] == d) for d in (None, 1, 2, 3)}
    assert total == {None: 3, 1: 3 + 3 + 2, 2: 1, 3: 1}
    assert all(r["padding"] == 0 and r["sequence_length"] <= 4 for r in got)


@pytest.mark.parametrize("filled", [False, True])
def test_pipeline_of_odd_tables(spark, small, tmp_path, filled):
    """Tables without rows; then rows of nulls, empty texts and repeated ids."""
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{small}/{name}.parquet")
        odd = rows.limit(0)
        if filled and name == "documents":
            text = F.when(F.col("doc_id") % 4 == 0, F.lit("")).when(F.col("doc_id") % 4 == 1, F.lit(None).cast("string")).otherwise(F.col("text"))
            odd = rows.limit(40).withColumn("text", text)
            odd = odd.unionByName(odd.limit(8))
        elif filled:
            odd = rows.unionByName(rows.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]).limit(3))
        odd.coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(out) == filled and all(r["length"] > 0 for r in out)


def test_words_that_share_a_key(monkeypatch):
    """All bits of a key but one tell words apart: at 14 bits and 1024 words about
    1 - exp(-1023 / 2 ** 13) of them, an eighth, meet another."""
    monkeypatch.setattr(lm_scoring, "KEY_BITS", 14)
    keys = lm_scoring.Events.cut(mixed(np.arange(1, 1025, dtype=np.uint64)))
    assert (keys % 2 == 0).all() and int(keys.max()) < 1 << 14
    _, numbers = np.unique(keys, return_inverse=True)
    assert 0.07 < (np.bincount(numbers)[numbers] > 1).mean() < 0.17
