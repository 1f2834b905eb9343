"""Redaction of personal data, capture modes and canonical JSON."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.by_row import by_row

#: Code points that a redacted field has at most.
FIELD_CHARS = 2000
# What the parts look like.
_EMAIL = regex.compile(r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}")
_PHONE = regex.compile(r"(?<![0-9])(?:\+84[ -]?(?:\(0\)[ -]?)?|0)[0-9](?:[ -]?[0-9]){7,8}(?![ -]?[0-9])")
_ID = regex.compile(r"(?<![0-9])(?:[0-9]{9}|[0-9]{12})(?![0-9])")
_RUN = regex.compile(r"(?<![0-9])[0-9]+(?:([ -])[0-9]+(?:\1[0-9]+)*)?(?![0-9])(?!\s*(?:đồng|vnđ|VND|₫))")
_DATE = regex.compile(r"[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}")
_YEAR = regex.compile(r"(?:19|20)[0-9]{2}")


def _account(match: regex.Match) -> str:
    run = match.group()
    groups = run.replace("-", " ").split(" ")
    years = len(groups) > 1 and all(_YEAR.fullmatch(g) for g in groups)
    return run if sum(map(len, groups)) < 8 or _DATE.fullmatch(run) or years else "[account]"


def redact_text(text: str) -> str:
    """Emails, phones, identity numbers and accounts as marks; NFC; cut."""
    s = unicodedata.normalize("NFC", text)
    for pattern, mark in ((_EMAIL, "[email]"), (_PHONE, "[phone]"), (_ID, "[id]"), (_RUN, _account)):
        s = pattern.sub(mark, s)
    return s[:FIELD_CHARS]


def mask(value: object, mode: str) -> object:
    """``full``: unchanged; ``masked``: strings redacted at any depth;
    ``metadata_only``: text and structure replaced, other scalars kept."""
    if mode == "full":
        return value
    if mode == "metadata_only":
        return "[redacted]" if isinstance(value, str | list | dict) else value
    if isinstance(value, str):
        return redact_text(value)
    if isinstance(value, list):
        return [mask(v, mode) for v in value]
    if isinstance(value, dict):
        return {k: mask(v, mode) for k, v in value.items()}
    return value


def _number(value: float) -> str:
    if value != value or value in (float("inf"), float("-inf")):
        raise ValueError("canonical JSON has finite numbers only")
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    text = repr(value)
    if "e" in text:
        digits, power = text.split("e")
        text = f"{digits}e{int(power):+d}"
    return text


def canonical_json(value: object) -> str:
    """Keys sorted by UTF-16 units, no white space, numbers as JavaScript
    writes them; numbers that aren't finite are errors."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in keys) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def row_hash(prev: str, body: str) -> str:
    return hashlib.sha256((prev + body).encode()).hexdigest()


redact = by_row(redact_text)


@by_row
def canonical(text: str) -> str:
    """Canonical form of JSON texts."""
    return canonical_json(json.loads(text))


def masked_json(text: Column, mode: str) -> Column:
    """A capture mode applied to a column of JSON texts."""
    return by_row(lambda s: json.dumps(mask(json.loads(s), mode), ensure_ascii=False))(text)


def chained_hash(prev: Column, body: Column) -> Column:
    """SHA-256 of the previous hash and the canonical body, in the JVM."""
    return F.sha2(F.concat(prev, body), 256)
