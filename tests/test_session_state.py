"""Windows as state with timers equal those of a batch, after expiry and reload too."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from weftgraph.streaming import memory, session_state

TURNS = session_state.TURN
LIMITS = memory.Limits(max_turns=3, max_tokens=60, history_tokens=40)


def turn(session, n, minute, owner="ann", answer=None):
    return (session, owner, f"r{n}", n, f"question {n} of {session}", f"answer {n} " + "word " * (n % 7) if answer is None else answer, minute)


def table(spark, rows):
    df = spark.createDataFrame(rows, TURNS.replace("at timestamp", "minute long"))
    return df.select("*", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000).alias("at")).drop("minute")


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", session_state.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, folder, batches, log=None, late="0 seconds", idle_ms=600_000, most=None):
    """All output rows of a query that takes the batches one after another; with
    ``most``, of one that goes on until it has given as many."""
    source = f"{folder}/in"
    for i, rows in enumerate(batches):
        table(spark, rows).coalesce(1).write.parquet(f"{source}/{i:03d}")
    schema = table(spark, batches[0]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    out = session_state.window_states(stream, idle_ms, LIMITS, log, late)
    got = []
    query = out.writeStream.outputMode("update").foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", f"{folder}/state").trigger(**({"processingTime": "1 second"} if most else {"availableNow": True})).start()
    until = time.monotonic() + 60
    while most and len(got) < most and query.isActive and time.monotonic() < until:
        time.sleep(0.5)
    if most:
        query.stop()
    query.awaitTermination(60)
    return got


def batch(spark, rows):
    return {r["session_id"]: tuple(r) for r in memory.windows(table(spark, rows), LIMITS).collect()}


def test_stream_equals_batch_after_expiry_and_reload(rocks, tmp_path):
    first = [[turn("s1", n, n) for n in range(1, 6)] + [turn("s2", 1, 1)], [turn("s2", 2, 60), turn("s2", 3, 61, answer="  ")], [turn("s2", 4, 62)], [turn("s2", 5, 63)]]
    got = run(rocks, f"{tmp_path}/a", first)
    so_far = [t for rows in first for t in rows]
    last = {r["session_id"]: r for r in got}
    assert tuple(last["s1"])[1:4] == (0, 0, 0) and last["s1"]["expired"] and last["s1"]["summary"] == ""
    assert [r["expired"] for r in got if r["session_id"] == "s1"] == [False, True]
    seen = next(r for r in got if r["session_id"] == "s1")
    assert tuple(seen)[:-1] == batch(rocks, first[0])["s1"] and seen["older"] == 2
    # A new query begins with the windows of the log, that of the forgotten session too.
    more = [[turn("s1", 6, 64), turn("s3", 1, 64)], [turn("s2", 6, 65), turn("s1", 7, 65)]]
    again = run(rocks, f"{tmp_path}/b", more, log=table(rocks, so_far))
    final = {r["session_id"]: tuple(r)[:-1] for r in again if not r["expired"]}
    assert final == batch(rocks, so_far + [t for rows in more for t in rows])


def test_history_may_come_as_rows(rocks, tmp_path):
    rows = [turn("s1", n, n) for n in range(1, 6)]
    got = run(rocks, f"{tmp_path}/a", [rows[:4], [turn("s2", 1, 99)], [turn("s2", 2, 99)], [turn("s1", n, 100) for n in range(1, 7)]])
    assert any(r["expired"] for r in got)
    assert tuple([r for r in got if r["session_id"] == "s1"][-1])[:-1] == batch(rocks, [*rows, turn("s1", 6, 100)])["s1"]


def test_owners_are_not_mixed(rocks, tmp_path):
    with pytest.raises(Exception, match="belongs to another owner"):
        run(rocks, f"{tmp_path}/a", [[turn("s1", 1, 1)], [turn("s1", 2, 2, owner="bob")]])


def test_the_clock_forgets(rocks, tmp_path):
    got = run(rocks, f"{tmp_path}/a", [[turn("s1", 1, 1)]], late=None, idle_ms=1500, most=2)
    assert [(r["session_id"], r["kept"], r["expired"]) for r in got] == [("s1", 1, False), ("s1", 0, True)]
