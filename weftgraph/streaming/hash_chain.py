"""Hash-chained logs: sealing in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftgraph.functions.privacy import row_hash
from weftgraph.operators.sessions import GENESIS

SCHEMA = "session_id string, seq long, body string, prev_hash string, row_hash string"
SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _sealed(session: str, rows: pd.DataFrame, prev: str) -> tuple[pd.DataFrame, str]:
    out = []
    for r in rows.sort_values("seq").itertuples():
        own = row_hash(prev, r.body)
        out.append((session, r.seq, r.body, prev, own))
        prev = own
    return pd.DataFrame(out, columns=["session_id", "seq", "body", "prev_hash", "row_hash"]), prev


def seal(records: DataFrame) -> DataFrame:
    """Links each session's canonical bodies in the order of ``seq``.

    Rows stream through in order and only the last hash is held, so a session
    may be of any length.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), GENESIS
        for part in batches:
            links, hashes = [], []
            for session, body in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                if session != now:
                    now, last = session, GENESIS
                links.append(last)
                last = row_hash(last, body)
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(links, type=pa.string()), pa.array(hashes, type=pa.string())], SCHEMA_NAMES)

    rows = records.select("session_id", F.col("seq").cast("long").alias("seq"), "body")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInArrow(run, SCHEMA)


def seal_stream(records: DataFrame) -> DataFrame:
    """The same of a stream: the state of a session is its last hash."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, last = _sealed(key[0], pd.concat(list(batches)), state.get[0] if state.exists else GENESIS)
        state.update((last,))
        yield rows

    return records.select("session_id", "seq", "body").groupBy("session_id").applyInPandasWithState(update, SCHEMA, "last string", "append", GroupStateTimeout.NoTimeout)
