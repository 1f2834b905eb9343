"""Memoised exact tokenisation on proven pre-token boundaries.

Both public BPE tokenizers used here split a text into pre-tokens before any
merge happens, and no pre-token holds white space after a character that is
not white space.  The point between a non-white character and a following
white character is therefore a boundary of the whole text's tokenisation, no
matter what stands on either side: the ids of a text are the ids of its
segments (a run of white space and the characters after it), concatenated.
Texts repeat their segments, so each distinct segment is encoded by the
library once and the rest is vectorised gathering.

The point between an ASCII letter and one of ``, . ; : ! ? $ % & * # " ( )``
is a boundary too: letters and such marks never share a pre-token, and none
of the marks belongs to a contraction or a special string.

Otherwise only ASCII white space starts a segment.  A segment also never starts behind
a character that may itself be Unicode white space (see ``cut_points``), and
never inside one of the tokenizer's special strings, as those hold no white
space.

All this holds for two kinds of tokenizer, which a file is recognised as by its
own description; any other file's texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

#: Entries that one worker's memo holds before it is emptied (about 100 MB).
MEMO_ENTRIES = 500_000

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b',.;:!?$%&*#"()')] = True

#: White space in front of, and letters of, a segment that is one pre-token.
#: These letters stay single code points under NFC and have one lower case.
_PLAIN = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_ASCII_PLAIN = re.compile(rb" ?[A-Za-z]+")
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
_TO_LOWER[9:14] = 32


def _byte_characters() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: a byte that prints in Latin-1
    stands for itself, the others follow from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_STAND_IN = _byte_characters()


def cut_points(data: np.ndarray) -> np.ndarray:
    """Offsets in UTF-8 bytes at which a new segment starts (0 excluded).

    A cut stands before an ASCII white byte whose predecessor ends a character
    that is surely not white space: an ASCII one, or a two-byte one with a lead
    of 0xC3 or more (U+0085 and U+00A0 have 0xC2; other Unicode spaces have
    three bytes).
    """
    if len(data) < 2:
        return np.empty(0, dtype=np.int64)
    white = _WHITE[data]
    last = data[:-1]
    sure = (last < 0x80) & ~white[:-1]
    sure[1:] |= (last[1:] >= 0x80) & (last[:-1] >= 0xC3) & (last[:-1] < 0xE0)
    # FS, GS, RS, US count as white for some engines and not for others.
    sure &= ~((last >= 0x1C) & (last <= 0x1F))
    return np.flatnonzero((white[1:] & sure) | (_LETTER[last] & _MARK[data[1:]])) + 1


def folded(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case and white space as spaces, in segments of
    ASCII alone.

    Others stay: the library composes characters before it folds case, and some
    letters have a composed form in lower case only (``t`` and U+0308).
    """
    out = _TO_LOWER[data]
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        mixed = np.zeros(len(bounds) - 1, dtype=bool)
        mixed[np.searchsorted(bounds, high, side="right") - 1] = True
        inside = np.repeat(mixed, np.diff(bounds))
        out[inside] = data[inside]
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls count as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    if column.buffers()[2] is None:
        return np.empty(0, dtype=np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def kind_of(path: str) -> str | None:
    """The kind of a tokenizer file: ``bytes`` (byte-level BPE on the usual
    pre-tokens), ``folding`` (lower case, white space dropped, word ends), or
    None if it is another, or has special strings that a segment could cut."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = lambda part, key: [x["type"] for x in part.get(key, [part])] if part else []
    normal, before = steps(spec["normalizer"], "normalizers"), spec["pre_tokenizer"] or {}
    plain = spec["model"]["type"] == "BPE" and not spec["post_processor"] and not spec["model"].get("dropout")
    whole = all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) and not len(cut_points(np.frombuffer(x["content"].encode(), dtype=np.uint8))) for x in spec["added_tokens"])
    if not plain or not whole:
        return None
    if not normal and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not spec["model"].get("end_of_word_suffix"):
        return "bytes"
    if normal == ["NFC", "Replace", "Lowercase"] and steps(before, "pretokenizers") == ["Split", "ByteLevel"]:
        replace, split, last = spec["normalizer"]["normalizers"][1], *before["pretokenizers"]
        pattern = split["pattern"].get("Regex", "")
        # White space goes, and every pre-token is letters, one number, marks, or a contraction.
        known = replace["pattern"] == {"Regex": r"\s+"} and replace["content"] == " " and split["invert"] and split["behavior"] == "Removed" and not last["use_regex"] and not last["add_prefix_space"]
        return "folding" if known and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") else None
    return None


class SegmentTokenizer:
    """A ``tokenizers`` file with a memo from segment to ids.

    ``ids_of(data, bounds)`` gives the segments' ids as (flat, starts, sizes,
    index): segment ``i`` has ``flat[starts[index[i]]:][:sizes[index[i]]]``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.kind = kind_of(path)
        self.folds = self.kind == "folding"
        self._clear()

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Proven boundaries of a text, whatever surrounds it; none if the
        tokenizer's kind isn't known."""
        return cut_points(data) if self.kind else np.empty(0, dtype=np.int64)

    def _clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 14, dtype=np.int64)
        self.sizes = np.empty(1 << 14, dtype=np.int32)

    def _grown(self, array: np.ndarray, need: int) -> np.ndarray:
        if need <= len(array):
            return array
        out = np.empty(max(need, 2 * len(array)), dtype=array.dtype)
        out[: len(array)] = array
        return out

    def _coded(self, part: list[bytes]) -> list[list[int]]:
        """The library's ids of each segment.

        A segment that is one pre-token goes to the library's BPE model at
        once; that skips its regular expressions, which take most of the time
        on short texts.  All others go through the whole of it.
        """
        out: list[list[int]] = [[]] * len(part)
        rest = []
        merge, plain, ascii_only, folds, space = self.model.tokenize, _PLAIN.fullmatch, _ASCII_PLAIN.fullmatch, self.folds, _STAND_IN[32]
        for i, raw in enumerate(part):
            if not self.kind:
                rest.append(i)
                continue
            if ascii_only(raw):
                text = raw.decode("ascii")
                text = text.lstrip().lower() if folds else text.replace(" ", space)
            elif plain(text := raw.decode("utf-8")):
                text = (text.lstrip().lower() if folds else text).encode("utf-8").decode("latin-1").translate(_STAND_IN)
            else:
                rest.append(i)
                continue
            out[i] = [x.id for x in merge(text)]
        texts = [part[i].decode("utf-8") for i in rest]
        for i, x in zip(rest, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def _learn(self, fresh: list[bytes]) -> None:
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            coded = self._coded(part)
            sizes = np.fromiter(map(len, coded), dtype=np.int32, count=len(coded))
            first, total = len(self.memo), int(sizes.sum())
            self.flat = self._grown(self.flat, self.used + total)
            self.starts = self._grown(self.starts, first + len(part))
            self.sizes = self._grown(self.sizes, first + len(part))
            self.flat[self.used : self.used + total] = [i for ids in coded for i in ids]
            self.starts[first : first + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[first : first + len(part)] = sizes
            self.used += total
            self.memo.update(zip(part, range(first, first + len(part)), strict=True))

    def index_of(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The memo entry of each segment ``data[bounds[i]:bounds[i + 1]]``."""
        if len(bounds) < 2:
            return np.empty(0, dtype=np.int64)
        if len(self.memo) > MEMO_ENTRIES:
            self._clear()
        data = np.ascontiguousarray(data)
        if self.folds and b"<|" not in data.tobytes():
            # This tokenizer folds case and white space itself; done before, fewer segments differ.
            data = folded(data, bounds)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int64)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        fresh = [k for k in keys if k not in self.memo]
        if fresh:
            self._learn(fresh)
        entry = np.fromiter(map(self.memo.__getitem__, keys), dtype=np.int64, count=len(keys))
        return entry[coded.indices.to_numpy(zero_copy_only=False)]

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Number of ids of each segment."""
        index = self.index_of(data, bounds)
        return self.sizes[index].astype(np.int64)

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments in a row, number of each segment's ids)."""
        index = self.index_of(data, bounds)
        sizes = self.sizes[index].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total, dtype=np.int64) + np.repeat(self.starts[index] - (ends - sizes), sizes)
        return self.flat[at], sizes


def document_bounds(tokenizer: SegmentTokenizer, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of all segments, for each document the first of them).

    Documents are cut from one another too; an empty one has no segment.
    """
    starts = np.zeros(len(data) + 1, dtype=bool)
    starts[tokenizer.cuts(data)] = True
    starts[offsets] = True
    bounds = np.flatnonzero(starts)
    return bounds, np.searchsorted(bounds, offsets)


_TOKENIZERS: dict[str, SegmentTokenizer] = {}


def tokenizer_of(path: str) -> SegmentTokenizer:
    """This worker's tokenizer for a file; its memo serves all its tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = SegmentTokenizer(path)
    return _TOKENIZERS[path]
