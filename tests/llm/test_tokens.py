from __future__ import annotations

import json
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftgraph.llm import packing, token_counts, token_files
from weftgraph.llm.common import shared_folder
from weftgraph.llm.segments import SegmentTokenizer, column_bytes, document_bounds, kind_of, tokenizer_of

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
LIBRARY = {f: Tokenizer.from_file(P.path(f)) for f in FILES}
#: Letters that have a composed form in lower case only, or in both, or none.
COMPOSED = ["T\u0308", "H\u0331", "W\u030a", "Y\u030a", "J\u030c", "don'T\u0308", "THE W\u030aORLD", "E\u0301", "t\u0308", "X\u0302", "A\u0328\u0301", "K\u0331", "\u212a", "\u0301"]
PIECES = st.sampled_from([
    " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "\u0085", "\x1c", "the", "The", "THE", "it's", "don'T", "'ll", "e\u0301", "é", "Ñandú", "ß", "İ", "日本", "🙂", ",", ".", "!!", "$$$", "##", "(a)", "12", "3.4",
    "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", "_", "-", "a-b", "\u0308", "\u200b",
    *COMPOSED,
])


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=300, deadline=None)
@example(texts=COMPOSED)
@example(texts=[" ".join(COMPOSED), "".join(COMPOSED)])
@given(texts=st.lists(st.lists(PIECES, max_size=12).map("".join) | st.text(max_size=20), max_size=4))
def test_segments_give_the_library_ids(file, texts):
    data, offsets = column_bytes(pa.array(texts, type=pa.string()))
    bounds, first = document_bounds(tokenizer_of(P.path(file)), data, offsets)
    ids, sizes = tokenizer_of(P.path(file)).ids(data, bounds)
    at = np.concatenate([[0], np.cumsum(sizes)])[first]
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == LIBRARY[file].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=100, deadline=None)
@given(text=st.lists(PIECES, min_size=1, max_size=60).map("".join), chunk=st.integers(8, 60), overlap=st.integers(1, 20))
def test_chunks_are_spliced_exactly(file, text, chunk, overlap):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    parts = list(token_counts.encode_huge(tokenizer_of(P.path(file)), data, chunk, overlap))
    assert np.concatenate(parts).tolist() == LIBRARY[file].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
def test_overlaps_widen_until_chunks_agree(file, monkeypatch):
    """No boundary in the first overlaps, then a stretch that is cut inside a word."""
    text = "start of it, " + "x" * 700 + " middle part here " + "日本語é" * 90 + " some more words " * 30 + "<|endoftext|>" * 20 + "z" * 333
    data, tries = np.frombuffer(text.encode(), dtype=np.uint8), []
    real = token_counts._Chunk.__init__
    monkeypatch.setattr(token_counts._Chunk, "__init__", lambda self, t, d, lo, hi: (tries.append((lo, hi)), real(self, t, d, lo, hi))[1])
    parts = list(token_counts.encode_huge(tokenizer_of(P.path(file)), data, 200, 16))
    assert np.concatenate(parts).tolist() == LIBRARY[file].encode(text, add_special_tokens=False).ids
    ends = [hi for _, hi in tries]
    assert len(parts) > 2 and any(a == b for a, b in zip(ends, ends[1:], strict=False))


def test_chunks_that_differ_are_not_aligned():
    tokenizer = tokenizer_of(P.path(FILES[0]))
    data = np.frombuffer(b"one two three four five six seven eight nine ten eleven twelve", dtype=np.uint8)
    left, right = token_counts._Chunk(tokenizer, data, 0, 50), token_counts._Chunk(tokenizer, data, 5, len(data))
    assert token_counts.aligned(left, right, 27, 0) and not token_counts.aligned(left, right, 25, 0)
    assert not token_counts.aligned(left, right, 23, 0)  # too near to where the right chunk was cut
    right.ids[5] += 1
    assert not token_counts.aligned(left, right, 27, 0)


def test_files_of_other_kinds_are_encoded_whole(tmp_path):
    spec = json.loads(LIBRARY[FILES[0]].to_str())
    assert [kind_of(P.path(f)) for f in FILES] == ["bytes", "folding"]
    text = "One  two,three " * 40
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [spec["added_tokens"][0] | {"rstrip": True}]}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        tokenizer, data = SegmentTokenizer(str(path)), np.frombuffer(text.encode(), dtype=np.uint8)
        assert tokenizer.kind is None
        wanted = Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
        assert np.concatenate(list(token_counts.encode_huge(tokenizer, data, 100, 16))).tolist() == wanted
        assert tokenizer.ids(data, document_bounds(tokenizer, data, np.array([0, len(data)]))[0])[0].tolist() == wanted


def test_counts_edge_cases(spark):
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string").withColumns({"id": F.lit("x"), "n_tokens": F.lit(9)})
    got = sorted(map(tuple, token_counts.count_tokens(rows, P.path(FILES[0])).collect()), key=str)
    assert got == sorted([(None, 3, 2, False), (1, 3, 2, False), (1, 3, 2, False), (2, 0, 0, False)], key=str)


def test_counts(docs, corpus, none):
    file = FILES[0]
    out = token_counts.count_tokens(docs.withColumnRenamed("doc_id", "id"), P.path(file), limit=100, id_col="id", chunk_bytes=1000, overlap_bytes=64)
    got = {r["id"]: tuple(r)[1:] for r in out.collect()}
    for i, text in corpus:
        n = len(LIBRARY[file].encode(text or "").ids)
        assert got[i] == (len((text or "").encode()), n, n > 100)
    assert token_counts.count_tokens(none, P.path(file)).count() == 0


def test_files_round_trip(spark, docs, corpus):
    file = FILES[1]
    path = shared_folder(spark, "ids")
    token_files.write_token_files(docs, path, P.path(file), end_id=2, files=4)
    read = token_files.read_token_files(spark, path)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.digests(read).collect()}
    lists = {r["doc_id"]: r["ids"] for r in read.collect()}
    start = 0
    for i, text in corpus:
        ids = [*LIBRARY[file].encode(text or "", add_special_tokens=False).ids, 2]
        assert lists[i] == ids
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_no_files(spark, none):
    path = shared_folder(spark, "ids")
    token_files.write_token_files(none, path, P.path(FILES[1]))
    assert token_files.digests(token_files.read_token_files(spark, path)).count() == 0


@pytest.mark.parametrize("size", [64, 2048])
def test_packing_is_whole(docs, corpus, size):
    rows = packing.pack(docs, P.path(FILES[1]), size=size, end_id=1).collect()
    whole = {i: np.array([*LIBRARY[FILES[1]].encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in corpus}
    windows: dict[int, list] = {}
    seen = {i: np.zeros(len(x), dtype=int) for i, x in whole.items()}
    for r in rows:
        own = whole[r["doc_id"]]
        piece = own[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(own) and r["length"] > 0
        seen[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all((x == 1).all() for x in seen.values())
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size and (at == size or at & (at - 1) == 0)


def test_sum_of_squares_rule():
    rng = np.random.default_rng(1)
    packer = packing.SumOfSquares(20)
    level = np.zeros(21, dtype=int)
    for s in rng.integers(1, 20, 500).tolist():
        def after(h, s=s):
            n = level.copy()
            if h:
                n[h] -= 1
            if h + s < 20:
                n[h + s] += 1
            return (n**2).sum()

        best = min(after(h) for h in range(21 - s) if h == 0 or level[h])
        packer.place((0, 0, np.zeros(s, dtype=np.uint32), s))
        level = packer.level[:21].copy()
        assert (level**2).sum() == best
