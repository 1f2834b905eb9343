"""SimHash near duplicates against brute force over all pairs."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import simhash_dedup as S

RNG = np.random.default_rng(5)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """The least index that is reachable over pairs within three bits."""
    value = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(value[:, None] ^ value[None, :]) <= 3
    label = np.arange(len(value))
    while True:
        least = np.where(near, label[None, :], len(value)).min(axis=1)
        if (least == label).all():
            return label
        label = least


def clustered(n, groups):
    """Fingerprints of which many lie near to others, in balls and in chains."""
    base = RNG.integers(0, 1 << 63, groups, dtype=np.uint64)
    out = base[RNG.integers(0, groups, n)]
    for _ in range(4):
        out = out ^ np.where(RNG.random(n) < 0.5, np.uint64(1) << RNG.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(np.concatenate([out, RNG.integers(0, 1 << 63, n, dtype=np.uint64)]))


@pytest.mark.parametrize("text", ["", "  \n", "a", "A b", "a b c", "A B C d", "x\x1cy z w", "é È ñ 日本 語", "same same same same same", "w " * 700, " ".join(str(i) for i in range(70_000))])
def test_fingerprints_of_texts(text):
    hashes = S.shingle_hashes(text.encode())
    assert int(S.majorities(hashes, np.array([0, len(hashes)]))[0]) == brute_fingerprint(text)


def test_many_runs_at_once():
    runs = [RNG.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 2, 254, 255, 256, 0, 0, 511, S.BLOCK + 3, 1, 0)]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    wanted = [sum(1 << b for b in range(64) if len(r) and 2 * int((r >> np.uint64(b) & np.uint64(1)).sum()) > len(r)) for r in runs]
    assert S.majorities(np.concatenate(runs), bounds).tolist() == wanted


def test_spark_has_the_same_hash(spark):
    words = ["one two three", "a", "é 日本 x", "x" * 100]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    assert all(r["h"] % (1 << 64) == xxhash.xxh64_intdigest(r["w"].encode(), 42) for r in rows)


def test_each_pair_meets_once_in_a_tree():
    values = S.half(clustered(400, 20), 0)
    tree = S.fit(values[::3], 4)
    row, shard, home = tree.routes(values, 1)
    assert sorted(row[home]) == list(range(len(values)))
    at_home, asking = {int(r): int(s) for r, s in zip(row[home], shard[home], strict=True)}, set(zip(row[~home].tolist(), shard[~home].tolist(), strict=True))
    assert len(asking) == (~home).sum()  # none asks a shard twice
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 1):
            if i < j:
                a, b = at_home[i], at_home[int(j)]
                assert a == b or ((i, b) in asking) != ((int(j), a) in asking)


@pytest.mark.parametrize("tree", [0, 1])
def test_pairs_of_a_shard(tree):
    fps = clustered(900, 30)
    every = np.arange(len(fps))
    got = {(int(a), int(b)) for x, y in S.near_pairs(fps, every[::2], every, tree) for a, b in zip(x, y, strict=True)}
    apart = lambda x, y: int(fps[x] ^ fps[y]).bit_count()
    assert all(apart(a, b) <= 3 for a, b in got)
    close = np.bitwise_count(S.half(fps, tree)[:, None] ^ S.half(fps, tree)[None, :]) <= 1
    wanted = {(int(a), int(b)) for a, b in np.argwhere(close) if a % 2 == 0 and apart(a, b) <= 3}
    assert wanted <= got


@pytest.mark.parametrize("rows", [1 << 15, 300])
def test_components_of_fingerprints(spark, monkeypatch, rows):
    """With deep trees; and with shards split into cells, a dense ball among them."""
    monkeypatch.setattr(S, "SHARD_ROWS", 64)
    monkeypatch.setattr(S, "HOME_ROWS", rows // 10)
    monkeypatch.setattr(S, "ASKING_ROWS", rows // 4)
    ball = np.uint64(0x123456789ABCDEF0) ^ (np.uint64(1) << RNG.integers(0, 64, 700).astype(np.uint64)) ^ (np.uint64(1) << RNG.integers(0, 64, 700).astype(np.uint64))
    fps = np.unique(np.concatenate([clustered(700, 60), ball, np.array([0, 7, (1 << 64) - 1], dtype=np.uint64)]))
    points = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    found = {int(r["node"]) % (1 << 64): int(r["component"]) for r in S.connected_components(S.links(points)).collect()}
    label = brute_components(fps)
    got = {}
    for i, fp in enumerate(fps.tolist()):
        got.setdefault(found.get(fp, ("alone", fp)), []).append(i)
    wanted = {}
    for i, x in enumerate(label.tolist()):
        wanted.setdefault(x, []).append(i)
    assert sorted(got.values()) == sorted(wanted.values())


def test_documents(docs, corpus, none):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for _, t in corpus]
    label = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", corpus[label[i]][0]) for i, _ in corpus}
    assert len(set(label.tolist())) < len(corpus) - 5
    assert S.near_duplicates(none).count() == 0


def test_odd_rows(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (2, None), (9, ""), (None, "nobody else has this text"), (3, "long words here " * 300_000)]
    table = spark.createDataFrame(rows, "id long, text string").withColumns({"doc_id": F.lit("x"), "fp": F.lit(1), "fingerprint": F.lit(0)})
    out = S.near_duplicates(table, id_col="id")
    assert out.columns == ["id", "fingerprint", "component_id"]
    got = sorted(((r["id"], r["component_id"]) for r in out.collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (2, 2), (9, 2), (None, None), (3, 3)], key=str)
