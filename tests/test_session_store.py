"""The store of session logs: chains, refusals, ends between any two steps, two writers, streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.privacy import canonical_json, row_hash
from weftgraph.operators.sessions import GENESIS
from weftgraph.sources import session_store as M
from weftgraph.sources.session_store import SessionStore, StoreError


def rec(session, seq, kind, run=None, content="", ok=None):
    return (session, run, seq, f"2026-01-01T00:00:{seq:02d}.000Z", kind, content, ok, None)


FIRST = [rec("s1", 1, "session_created"), rec("s1", 2, "query", "r1", "  what  is\nthis "), rec("s2", 1, "session_created")]
SECOND = [rec("s1", 3, "step", "r1", "look"), rec("s1", 4, "answer", "r1", "a thing", True), rec("s3", 1, "session_created"), rec("s3", 2, "query", "r1", "again"), rec("s3", 3, "error", "r1", "no")]


def frame(spark, rows):
    return spark.createDataFrame(rows, M.RECORD).repartition(2)


@pytest.fixture
def store(spark, tmp_path):
    return SessionStore(spark, f"file://{tmp_path}/store", patience=0).open()


def state(store):
    """What a new reader sees."""
    seen = SessionStore(store.spark, store.root).open()
    return seen.version, sorted(tuple(r) for r in seen.records().select("session_id", "seq", "row_hash").collect()), sorted(tuple(r) for r in seen.index().drop("version").collect())


def test_appends_chain_and_index(spark, store):
    assert store.version == 0 and store.index().count() == 0
    assert store.append(frame(spark, FIRST), owner="ann") == 1
    assert store.append(frame(spark, SECOND), owner="bob") == 2
    assert store.append(frame(spark, []), owner="bob") == 2
    last = {}
    for r in sorted(store.records().collect(), key=lambda r: (r["session_id"], r["seq"])):
        body = json.loads(r["line"])
        hashed = body.pop("row_hash")
        assert r["line"] == canonical_json(body | {"row_hash": hashed})
        assert body["prev_hash"] == last.get(r["session_id"], GENESIS) and hashed == r["row_hash"] == row_hash(body["prev_hash"], canonical_json(body))
        assert body["seq"] == r["seq"] and ("ok" in body) == (r["kind"] == "answer") and "run_id" in body
        last[r["session_id"]] = hashed
    index = {r["session_id"]: r for r in store.index().collect()}
    assert {s: r["last_row_hash"] for s, r in index.items()} == last
    one = index["s1"]
    assert (one["owner"], one["title"], one["turns"], one["record_count"], one["last_active_at"], one["created_at"]) == ("ann", "what is this", 1, 4, "2026-01-01T00:00:04.000Z", "2026-01-01T00:00:01.000Z")
    assert (index["s3"]["owner"], index["s3"]["turns"], index["s2"]["title"]) == ("bob", 1, "")
    assert store.records(1).count() == 3 and store.index(1).count() == 2


BAD = {
    "seq_gap": [rec("s1", 4, "step", "r1")], "repeated_query": [rec("s1", 3, "query", "r1")], "without_query": [rec("s2", 2, "answer", "r9", "x", True)], "first_not_created": [rec("new", 1, "query", "r1")], "created_not_first": [rec("s1", 3, "session_created")],
    "unknown_kind": [rec("s1", 3, "note", "r1")], "too_long": [rec("s1", 3, "answer", "r1", "x" * 32_001, True)], "missing_field": [rec("s1", 3, "answer", "r1", "no ok")],
    "after_deleted": [rec("s2", 2, "deleted"), rec("s2", 3, "query", "r1", "late")],
}


def test_bad_batches_change_nothing(spark, store):
    store.append(frame(spark, FIRST))
    before = state(store)
    for rule, rows in BAD.items():
        with pytest.raises(StoreError, match=rule):
            store.append(frame(spark, [*SECOND[2:], *rows]))
    assert state(store) == before and store.unnamed() == []
    assert store.append(frame(spark, SECOND)) == 2  # a refusal doesn't end the store


def test_deleted_sessions_refuse(spark, store):
    store.append(frame(spark, [*FIRST, rec("s2", 2, "deleted")]))
    assert store.index().where("hidden").first()["session_id"] == "s2"
    with pytest.raises(StoreError, match="after_deleted"):
        store.append(frame(spark, [rec("s2", 3, "query", "r1", "late")]))


def end_at(monkeypatch, store, step):
    """Has a writer end at a step, as if its process were gone."""

    def end(*_):
        raise OSError("gone")

    real = store._rename
    if step == "before staging":
        monkeypatch.setattr(store, "_stage", end)
    elif step == "after staging":
        monkeypatch.setattr(store, "_commit", end)
    elif step == "before the commit's name":
        monkeypatch.setattr(store, "_rename", end)
    elif step == "after the commit":
        monkeypatch.setattr(store, "_write_index", end)
    else:
        monkeypatch.setattr(store, "_rename", lambda a, b: real(a, b) if b.startswith("log/") else end())


STEPS = {"before staging": False, "after staging": False, "before the commit's name": False, "after the commit": True, "before the index's name": True}


@pytest.mark.parametrize("step", STEPS)
def test_ends_between_steps(spark, store, monkeypatch, step):
    """The batch is out, or in whole; appending it again gives what one append gives."""
    store.append(frame(spark, FIRST), 0, "ann")
    before = state(store)
    end_at(monkeypatch, store, step)
    with pytest.raises(OSError):
        store.append(frame(spark, SECOND), 1, "bob")
    for use in (lambda: store.append(frame(spark, []), 2), store.records, store.index, lambda: store.version):
        with pytest.raises(StoreError, match="refused since a write failed"):
            use()
    again = SessionStore(spark, store.root, patience=0)
    if STEPS[step]:
        with pytest.raises(StoreError, match="have no index"):
            again.open()
        with pytest.raises(StoreError, match="must come first"):
            again.index()
        again.recover()
    else:
        assert state(store) == before
        again.open()
    assert again.append(frame(spark, SECOND), 1, "bob") == 2
    whole = SessionStore(spark, store.root + "-whole").open()
    whole.append(frame(spark, FIRST), 0, "ann")
    whole.append(frame(spark, SECOND), 1, "bob")
    assert state(again) == state(whole)


def test_a_batch_comes_once(spark, store):
    for _ in range(2):
        assert store.append(frame(spark, FIRST), 5) == 1
    assert store.append(frame(spark, SECOND), 6) == 2
    before = state(store)
    assert store.append(frame(spark, FIRST), 5) == 1 and state(store) == before
    other = SessionStore(spark, store.root, app="other").open()
    assert other.append(frame(spark, [rec("s4", 1, "session_created")]), 5) == 3


def test_two_writers(spark, store, monkeypatch):
    """One comes first with the same number; the other judges and seals anew."""
    other = SessionStore(spark, store.root, app="other").open()
    store.append(frame(spark, FIRST))
    real, first = store._stage, []

    def late(rows):
        data = real(rows)
        if not first:
            first.append(other.append(frame(spark, [rec("s1", 3, "step", "r1", "other")])))
        return data

    monkeypatch.setattr(store, "_stage", late)
    with pytest.raises(StoreError, match="s1:3: seq_gap"):  # the place is taken now
        store.append(frame(spark, [rec("s1", 3, "step", "r1", "mine")]))
    first.clear()
    monkeypatch.setattr(other, "_judged", lambda b, o, f=other._judged: f(frame(spark, [rec("s1", 4, "step", "r1", "more")]), o))
    assert store.append(frame(spark, [rec("s5", 1, "session_created")])) == 4
    assert [r["content"] for r in store.records().where("session_id = 's1' and seq > 2").orderBy("seq").collect()] == ["other", "more"]
    assert len(store.unnamed()) == 2  # staged for numbers that were taken


def test_missing_commits_are_found(spark, store):
    store.append(frame(spark, FIRST))
    store.append(frame(spark, SECOND))
    store._fs.delete(store._path(f"{store.root}/log/{1:020d}.json"), False)
    with pytest.raises(StoreError, match="commits are missing"):
        SessionStore(spark, store.root).open()


def test_index_is_written_whole_now_and_then(spark, store, monkeypatch):
    monkeypatch.setattr(M, "WHOLE_EVERY", 2)
    store.append(frame(spark, FIRST))
    store.append(frame(spark, [rec("s9", 1, "session_created")]))
    assert spark.read.parquet(f"{store.root}/index/{2:020d}").count() == 3
    store.append(frame(spark, SECOND))
    assert spark.read.parquet(f"{store.root}/index/{3:020d}").count() == 2
    assert {r["session_id"]: r["record_count"] for r in store.index().collect()} == {"s1": 4, "s2": 1, "s3": 3, "s9": 1}


def test_stream_into_the_store(spark, store, tmp_path):
    """A stream that is run twice from the start of its source appends once."""
    for i, rows in enumerate((FIRST, SECOND)):
        frame(spark, rows).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")
    for _ in range(2):
        source = spark.readStream.schema(M.RECORD).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"{tmp_path}/in/*")
        query = source.writeStream.foreachBatch(store.sink()).option("checkpointLocation", f"{tmp_path}/check{_}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert store.records().agg(F.count("*")).first()[0] == 8
    assert store.version == 2
