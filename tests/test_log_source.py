"""Session logs by lines: any split gives the same lines; what verification finds."""

from __future__ import annotations

import json
import random

import pytest

from weftgraph.functions.privacy import canonical_json, row_hash
from weftgraph.operators.sessions import GENESIS
from weftgraph.sources.log_source import LineReader, read_log_lines, verify_lines


def log(session, n, content=lambda i: f"text {i} é x"):
    prev, out = GENESIS, []
    for i in range(1, n + 1):
        body = {"session_id": session, "run_id": None, "seq": i, "created_at": "t", "kind": "session_created" if i == 1 else "query", "content": content(i), "prev_hash": prev}
        prev = row_hash(prev, canonical_json(body))
        out.append(canonical_json(body | {"row_hash": prev}))
    return out


def put(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.mark.parametrize("split", [9, 40, 1 << 20])
def test_splits_give_the_same_lines(spark, tmp_path, split):
    rng = random.Random(4)
    texts = {f"f{i}.jsonl": "\n".join("x" * rng.choice([0, 1, 3, 30]) for _ in range(rng.randrange(1, 9))) + rng.choice(["", "\n", "\n\n"]) for i in range(4)} | {"deep/er/g.jsonl": "é\n日本\r\n", "empty.jsonl": "", "end.jsonl": "\n"}
    for name, text in texts.items():
        put(tmp_path, name, text)
    put(tmp_path, "other.txt", "not read")
    got = {}
    for r in read_log_lines(spark, f"file://{tmp_path}", split_bytes=split).collect():
        got.setdefault(r["file"], []).append((r["line"], None if r["text"] is None else bytes(r["text"]).decode(), r["torn"]))
    wanted = {}
    for name, text in texts.items():
        *whole, tail = text.split("\n")
        wanted[name] = [(i + 1, x, False) for i, x in enumerate(whole)] + ([(len(whole) + 1, tail, True)] if tail else []) + ([(1, None, True)] if not text else [])
    assert {k: sorted(v) for k, v in got.items()} == wanted


def test_what_verification_finds(spark, tmp_path):
    lines = log("s", 6)
    changed = json.loads(lines[2])
    cases = {
        "clean": (lines, None), "long": (log("long", 3000), None), "edited": ([*lines[:2], canonical_json(changed | {"content": "other"}), *lines[3:]], 3), "swapped": ([lines[0], lines[2], lines[1], *lines[3:]], 2), "spaced": ([*lines[:3], json.dumps(json.loads(lines[3])), *lines[4:]], 4),
        "dropped": ([*lines[:3], *lines[4:]], 4), "repeated": ([*lines[:2], lines[1], *lines[2:]], 3), "no_json": ([*lines[:4], "{", lines[5]], 5), "no_record": (["[]", *lines[1:]], 1), "other_start": (lines[1:], 1), "blank": ([*lines, ""], 7), "kind": ([lines[0].replace("session_created", "note")], 1),
    }
    for name, (rows, _) in cases.items():
        # Each session's log is sealed under its own name.
        own = [r.replace('"session_id":"s"', f'"session_id":"{name}"') for r in rows]
        if name not in ("clean", "long"):
            sealed = {r: s for r, s in zip(lines, log(name, 6), strict=True)}
            own = [sealed.get(r, r.replace('"session_id":"s"', f'"session_id":"{name}"')) for r in rows]
        else:
            own = log(name, len(rows))
        put(tmp_path, f"{name}.jsonl", "\n".join(own) + "\n")
    put(tmp_path, "torn.jsonl", "\n".join(log("torn", 4)))
    put(tmp_path, "empty.jsonl", "")
    put(tmp_path, "bytes.jsonl", (log("bytes", 2)[0] + "\n").encode() + b"\xff\xfe\n")
    put(tmp_path, "session_id=part/part-0.jsonl", "\n".join(log("part", 3)) + "\n")
    put(tmp_path, "foreign.jsonl", "\n".join(log("somebody", 3)) + "\n")
    wanted = {name: ((first or len(rows) + 1) - 1, first) for name, (rows, first) in cases.items()}
    wanted |= {"torn": (3, 4), "empty": (0, 1), "bytes": (1, 2), "part": (3, None), "foreign": (0, 1)}
    got = {r["session_id"]: (r["good"], r["first_bad"]) for r in verify_lines(read_log_lines(spark, f"file://{tmp_path}", split_bytes=900)).collect()}
    assert got == wanted


def test_many_sessions_a_file(spark, tmp_path):
    """Lines of sessions that share files, in turn as well, verify as their own files do."""
    names = [f"s{i}" for i in range(40)]
    logs = {name: log(name, 2 + i % 7) for i, name in enumerate(names)}
    logs["s3"][1], logs["s5"][3] = logs["s3"][1].replace(',"kind":', ', "kind":'), logs["s5"][3].replace('"s5"', '"s6"')
    for f in range(2):
        own = [n for i, n in enumerate(names) if i % 2 == f]
        lines = [f"{n}\t{logs[n][j]}\n" for j in range(8) for n in own if j < len(logs[n])]
        put(tmp_path, f"part-{f}.txt", "".join(lines) + ("no key\n" if f else ""))
    wanted = {n: (len(x), None) for n, x in logs.items()} | {"s3": (1, 2), "s5": (3, 4), "": (0, 1)}
    for split in (60, 4096):
        got = {r["session_id"]: (r["good"], r["first_bad"]) for r in verify_lines(read_log_lines(spark, f"file://{tmp_path}", suffix=".txt", split_bytes=split, keyed=True)).collect()}
        assert got == wanted


@pytest.mark.parametrize("keyed", [False, True])
def test_small_ranges_share_a_task(tmp_path, keyed):
    for i in range(900):
        put(tmp_path, f"f{i}.txt", f"k\t{i}\n")
    reader = LineReader(f"file://{tmp_path}", ".txt", 2, keyed)
    parts = reader.partitions()
    assert len(parts) < 20
    found = [x for p in parts for b in reader.read(p) for x in b.to_pylist()]
    assert sorted(x["text"] for x in found) == sorted((str(i) if keyed else f"k\t{i}").encode() for i in range(900))
