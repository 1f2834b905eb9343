from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import decontamination, jaccard_join, lm_scoring, quality, suffix_dedup
from weftgraph.llm.components import connected_components
from weftgraph.llm.shingles import words_of

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def split(text):
    return (text or "").encode().translate(LOWER).split()


def shingle_set(text):
    w = split(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_words(corpus):
    words = words_of(pa.array([t for _, t in corpus], type=pa.string()))
    seen = {}
    for i, (_, text) in enumerate(corpus):
        own = words.hashes[words.bounds[i] : words.bounds[i + 1]].tolist()
        expected = split(text)
        assert len(own) == len(expected)
        for h, w in zip(own, expected, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("group_bytes", [48 << 20, 2000])
def test_jaccard_components(docs, corpus, monkeypatch, group_bytes):
    monkeypatch.setattr(jaccard_join, "GROUP_BYTES", group_bytes)  # small: blocks and cells
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute_components(corpus)


@pytest.mark.parametrize("small", [2, 30, 200])
def test_any_boundary_gives_the_same(docs, corpus, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "_boundary", lambda *a: small)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute_components(corpus)


def test_bitmaps_never_lose_a_link():
    rng = np.random.default_rng(3)
    t = jaccard_join.Threshold(75, 100)
    universe = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    sets = []
    for _ in range(60):
        base = rng.choice(universe, rng.integers(5, 400), replace=False)
        sets += [np.sort(base), np.sort(base[: max(2, int(len(base) * rng.uniform(0.7, 1)))])]
    ids, sizes = np.arange(len(sets)) + 10, np.array([len(s) for s in sets])
    hub, doc = jaccard_join._possible(ids, sizes, [jaccard_join._bitmap(s) for s in sets], t)
    home = dict(zip(doc.tolist(), hub.tolist(), strict=True))
    for i in range(len(sets)):
        for j in range(i):
            if t.linked(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j]):
                assert home[int(ids[i])] == home[int(ids[j])]


def test_join_edge_cases(spark, none):
    assert jaccard_join.jaccard_components(none).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b"), (3, "A  b")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.jaccard_components(rows).collect()), key=str)
    assert got == sorted([(None, 1, None), (5, 1, 3), (5, 1, 3), (3, 1, 3)], key=str)
    kept = jaccard_join.keep_one(rows.withColumn("n", F.lit(1)).where("doc_id is not null"))
    assert [r["doc_id"] for r in kept.collect()] == [3] and kept.columns == ["doc_id", "text", "n"]


def brute_repeats(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeated_bytes(docs, corpus):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeated_bytes(docs).collect()}
    assert got == brute_repeats(corpus)


def test_repeats_of_all_offsets(spark):
    """Matches of 49 to 55 bytes at any place, one character apart."""
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = letters(55)
    rows = [(0, letters(30) + shared + letters(30))]
    for n in range(49, 56):
        for k in range(56 - n):
            rows.append((len(rows), letters(int(rng.integers(0, 40))) + shared[k : k + n] + letters(int(rng.integers(0, 40)))))
    rows += [(len(rows), shared * 3), (len(rows) + 1, "aaaa" * 60), (len(rows) + 2, "a" * 60)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_repeats(rows)


def test_blocks_of_entries_join(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BLOCK_BITS", 8)
    monkeypatch.setattr(suffix_dedup, "_MASK", np.uint64(255))
    text = "".join(map(chr, np.random.default_rng(2).integers(97, 123, 2000)))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    entries = suffix_dedup.Entries(data, np.array([0, len(data)]))
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(entries.first, entries.last, strict=True)])
    assert sorted(starts.tolist()) == list(range(len(text) - 49))


def test_entries_do_not_depend_on_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BLOCK_BITS", 8)
    monkeypatch.setattr(suffix_dedup, "_MASK", np.uint64(255))
    text = np.random.default_rng(2).integers(97, 123, 2000).astype(np.uint8)
    found = []
    for before in (0, 1, 50, 77, 128):
        data = np.concatenate([np.full(before, 65, dtype=np.uint8), text])
        e = suffix_dedup.Entries(data, np.array([0, before, len(data)]))
        own = e.doc == 1
        found.append(list(zip(e.whole[own].tolist(), e.rows(np.flatnonzero(own)).tolist(), *((c[own] - before).tolist() for c in (e.place, e.first, e.last)), strict=True)))
    assert all(f == found[0] for f in found)


def test_repeats_over_several_blocks(spark):
    """Rows with a null id shift the texts in some passes and not in others."""
    rng = np.random.default_rng(9)
    passages = ["".join(map(chr, row)) for row in rng.integers(97, 123, (60_000, 50))]
    rows = [(None, "n" * int(n)) for n in rng.integers(100, 900, 60)] + [(1, "0".join(passages)), (2, "A".join(passages))]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: 0, 1: 0, 2: 50 * len(passages)}


def test_suffix_order():
    rng = np.random.default_rng(4)
    rows = np.zeros((700, 96), dtype=np.uint8)
    rows[:, :50] = np.repeat(rng.integers(0, 2, (700, 10)), 5, axis=1) * 97
    order = suffix_dedup.suffix_order(rows, 0, 56)
    found = [rows[i].tobytes() for i in order]
    assert found == sorted(found)
    common = suffix_dedup.common_prefix(rows[order][1:, :50], rows[order][:-1, :50])
    assert common.tolist() == [next((k for k in range(50) if a[k] != b[k]), 50) for a, b in zip(found[1:], found[:-1], strict=True)]


def test_runs_over_many_buckets(spark, monkeypatch):
    """One passage in all documents, with other bytes around, and few bytes a bucket."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", (20, 20))
    rng = np.random.default_rng(12)
    letters = lambda n: "".join(map(chr, rng.integers(97, 100, n)))
    passage = letters(61)
    rows = [(i, letters(int(rng.integers(0, 60))) + passage + letters(int(rng.integers(0, 60)))) for i in range(150)]
    rows += [(150 + i, letters(200)) for i in range(20)] + [(200, passage[:49] * 4), (201, passage[:49] * 4), (202, passage[:50] * 3)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_repeats(rows)


def test_keys_are_dealt_in_turn(spark):
    """No task gets two buckets or groups of documents while another gets none."""
    keys = lambda rows: max(rows.rdd.mapPartitions(lambda own: [len({r["at"] for r in own})]).collect())
    buckets = spark.range(96).select(F.col("id").alias("at"))
    assert keys(suffix_dedup.dealt(buckets, 96)) == 1
    groups = spark.range(96).select((F.floor(F.col("id") / 4) * (1 << 21) + F.col("id") % 4).alias("at"))
    assert keys(suffix_dedup.dealt(groups, 96, 4)) == 1
    assert keys(suffix_dedup.dealt(groups, 48, 4)) == 2


def test_heads_are_spread_over_buckets(spark, small):
    """Minimisers have small hashes, but no bucket gets many more heads than another."""
    slim = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("uid"), F.col("doc_id").alias("id"), "text")
    by = {r["at"]: r["n"] for r in suffix_dedup._heads(slim, 32).where("kind = cast('h' as binary)").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    assert len(by) == 32 and max(by.values()) < 1.5 * sum(by.values()) / 32


def test_repeats_in_one_partition(spark, monkeypatch):
    """Parts follow the bytes of the texts, batches are small meanwhile."""
    assert suffix_dedup.parts_for(10 << 30, 40) == 1280 and suffix_dedup.parts_for(0, 1) == 8 and suffix_dedup.parts_for(100, 9) == 27
    before, seen, table = spark.conf.get(suffix_dedup.BATCH_BYTES), [], suffix_dedup.bucketed
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "bucketed", lambda df, name, parts, *a, **b: (seen.append((parts, spark.conf.get(suffix_dedup.BATCH_BYTES))), table(df, name, parts, *a, **b))[1])
    rng = np.random.default_rng(5)
    passage = "".join(map(chr, rng.integers(97, 123, 70)))
    rows = [(i, "".join(map(chr, rng.integers(97, 123, 400))) + passage * (i % 3 == 0)) for i in range(40)] + [(40, None)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == brute_repeats(rows)
    assert seen == [(17, str(suffix_dedup.SLICE_BYTES))] and spark.conf.get(suffix_dedup.BATCH_BYTES) == before


def test_repeats_edge_cases(spark, none):
    assert suffix_dedup.repeated_bytes(none).count() == 0
    text = "é" * 40 + "x" * 30
    rows = spark.createDataFrame([(1, text, "u"), (1, text, "v"), (2, "日" + text, "w"), (None, text, None), (3, None, "z")], "doc_id long, text string, uid string").withColumns({"removed": F.lit(1), "masks": F.lit("m")})
    assert suffix_dedup.drop_repeats(rows).columns == rows.columns
    kept = sorted(((r["doc_id"] or 0, r["text"], r["uid"]) for r in suffix_dedup.drop_repeats(rows).collect()), key=str)
    assert kept == sorted([(1, text, "u"), (1, text, "v"), (2, "日", "w"), (0, text, None), (3, None, "z")], key=str)
    with pytest.raises(TypeError):
        suffix_dedup.repeated_bytes(rows.withColumn("doc_id", F.lit("x")))


def brute_leaks(rows, items, threshold=0.75):
    """All windows of each item's size; weighted shingles without fingerprints."""
    def bag(w):
        return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])

    found = {}
    for d, text in rows:
        w = split(text)
        for i, item in items:
            v = split(item)
            if not v:
                continue
            own = bag(v)
            best = 0.0
            for s in range(len(w) - len(v) + 1):
                other = bag(w[s : s + len(v)])
                both = sum((own & other).values())
                best = max(best, both / sum((own | other).values()))
            if best >= threshold:
                found[d, i] = round(best, 9)
    return found


def test_leaks(spark, docs, corpus):
    long = corpus[-5][1].split()
    changed = long[:30]
    changed[15] = "changed"
    items = [(1, " ".join(corpus[40][1].split()[10:40])), (2, " ".join(changed)), (3, "never seen words here at all"), (4, "a b c"), (5, None), (6, ""), (7, " ".join(corpus[50][1].split()[3:60])), (8, "a " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontamination.find_leaks(docs, bench).collect()}
    wanted = brute_leaks(corpus, items)
    # The radius is a part of the definition: all that is clearly alike is found.
    assert {k for k, v in wanted.items() if v >= 0.85} <= set(got) <= set(wanted)
    assert all(wanted[k] == v for k, v in got.items())
    kept = {r["doc_id"] for r in decontamination.drop_leaks(docs, bench).collect()}
    assert kept == {d for d, _ in corpus} - {d for d, _ in got}


def test_leaks_of_documents_shorter_than_the_item(spark):
    """Against bags of the whole documents; 59 words, of which some are cut."""
    w = [f"w{i}" for i in range(59)]
    rows = [(k, " ".join(w[k // 2 : 59 - (k - k // 2)])) for k in range(30)] + [(50, " ".join(w[:4])), (51, ""), (52, None), (53, " ".join(w[1:] + ["other"]))]
    bag = lambda x: Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
    wanted = {}
    for d, text in rows:
        own, other = bag(split(" ".join(w))), bag(split(text))
        similar = sum((own & other).values()) / sum((own | other).values())
        if similar >= 0.75:
            wanted[d] = round(similar, 9)
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.find_leaks(docs, items).collect()}
    assert {d for d, s in wanted.items() if s >= 0.85} <= set(got) <= set(wanted) and len(wanted) > 13
    assert all(round(r["similarity"], 9) == wanted[d] and r["start"] == 0 for d, r in got.items())
    assert {r["doc_id"] for r in decontamination.drop_leaks(docs, items).collect()} == {d for d, _ in rows} - set(got)


def test_hamming_index_finds_all():
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    queries = np.concatenate([prints ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(0, 26, 3)])
    q, f = decontamination.HammingIndex(prints, 19).near(queries)
    wanted = {(i, j) for i in range(len(queries)) for j in range(50) if bin(int(queries[i] ^ prints[j])).count("1") <= 19}
    assert set(zip(q.tolist(), f.tolist(), strict=True)) == wanted


def test_leaks_without_rows(spark, docs, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(docs, empty).count() == 0
    assert decontamination.find_leaks(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 130)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    near = defaultdict(set)
    for a, b in pairs:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    wanted = {}
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        wanted[n] = min(seen)
    assert got == wanted
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_quality(spark, small):
    docs, labels = spark.read.parquet(f"{small}/../sf0.01/documents.parquet"), spark.read.parquet(f"{small}/../sf0.01/labels.parquet")
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"]]
    good, bad = [r["score"] for r in held if r["quality"]], [r["score"] for r in held if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_edge_cases(spark, docs, corpus, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert quality.score_documents(docs, labels).count() == len(corpus)
    assert quality.score_documents(none, labels).count() == 0
    kept = quality.keep_good(docs.withColumn("score", F.lit("own")), labels)
    assert kept.columns == ["doc_id", "text", "score"]


def test_features_of_texts():
    x = quality.text_features(pa.array([None, "", "AB ab!!", "one one one", "a|b\n$$$"]))
    names = {n: i for i, n in enumerate(quality.FEATURES)}
    assert not x[0].any() and not x[1].any()
    assert x[2, names["bang_share"]] == 2 / 7 and x[2, names["run_share"]] == 1 / 7
    assert x[4, names["run_share"]] == 2 / 7 and x[4, names["pipe_share"]] == 1 / 7


def brute_scores(rows, targets, prior=50.0, added=0.1):
    """Counts of all words by dictionaries, without the document's own."""
    def events(words):
        seq = ["", *words, ""]
        return list(zip(seq[:-1], seq[1:], strict=True)) if words else []

    def model(texts):
        pairs = Counter(e for w in texts for e in events(w))
        return pairs, Counter(w for x in texts for _, w in events(x))

    lists = [split(t) for _, t in rows]
    both = [model([w for (i, _), w in zip(rows, lists, strict=True) if i in targets]), model(lists)]
    total = [sum(m[1].values()) for m in both]
    types, scale = max(1, len(both[1][1])), min(1.0, total[0] / total[1]) if total[1] else 1.0
    out = []
    for (i, _), words in zip(rows, lists, strict=True):
        own = model([words])
        figures = []
        for (pairs, singles), n, by, mine in ((both[0], total[0], 1.0, i in targets), (both[1], total[1], scale, True)):
            loss = 0.0
            for h, w in events(words):
                p, c, g, m = pairs[h, w], singles[w], singles[h], n
                if mine:
                    p, c, g, m = p - own[0][h, w], c - own[1][w], g - own[1][h], m - len(words) - 1
                q = (by * c + added) / (by * m + added * types)
                loss -= np.log2((by * p + prior * q) / (by * g + prior))
            figures.append(loss / max(1, len(events(words))))
        out.append((i, len(words), *figures, figures[0] - figures[1]))
    return out


@pytest.mark.parametrize("bucket_bytes", [4 << 20, 2000])
def test_lm_scoring(spark, docs, corpus, none, monkeypatch, bucket_bytes):
    """Over a vocabulary of all words, in one bucket and in many."""
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", (bucket_bytes, bucket_bytes))
    targets = {i for i, _ in corpus if i % 3 == 0}
    labels = spark.createDataFrame([(i, int(i in targets)) for i, _ in corpus] + [(0, 1), (1, None), (None, 1), (9999, 1)], "doc_id long, quality int")
    got = sorted(map(tuple, lm_scoring.score_documents(docs.withColumns({"n": F.lit(1), "score": F.lit("own"), "kind": F.lit("k")}), labels).collect()))
    for r, w in zip(got, sorted(brute_scores(corpus, targets)), strict=True):
        assert r[:2] == w[:2] and r[2:] == pytest.approx(w[2:], abs=1e-9)


def test_lm_scoring_edge_cases(spark, none):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert lm_scoring.score_documents(none, labels).count() == 0
    rows = [(None, "a b"), (1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, "a " * 5000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, lm_scoring.score_documents(frame, labels).collect()), key=str)
    wanted = sorted(brute_scores(rows, {1}), key=str)
    assert [r[:2] for r in got] == [w[:2] for w in wanted]
    assert all(r[2:] == pytest.approx(w[2:], abs=1e-9) for r, w in zip(got, wanted, strict=True))
    assert {r["score"] for r in lm_scoring.score_documents(frame, labels.limit(0)).collect()} == {0.0}
    named = spark.createDataFrame([("x", "a b"), ("y", "b c")], "name string, text string")
    assert lm_scoring.score_documents(named, spark.createDataFrame([("x", 1)], "doc_id string, quality int"), id_col="name").count() == 2
