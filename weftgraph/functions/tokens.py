"""Token budgets in Python, shared by UDFs and the conversation window."""

from __future__ import annotations

import unicodedata

from weftgraph.functions.by_row import by_row


def count(text: str) -> int:
    s = unicodedata.normalize("NFC", text)
    units = len(s) + sum(1 for c in s if ord(c) > 0xFFFF)
    return max(len(s.split()), -(-units // 4))


def cap(text: str, most: int) -> str:
    """The longest prefix, by code points, of at most ``most`` tokens."""
    if most <= 0:
        return ""
    if count(text) <= most:
        return text
    s = unicodedata.normalize("NFC", text)
    fits, fails = 0, len(s)
    while fails - fits > 1:
        middle = (fits + fails) // 2
        if count(s[:middle]) <= most:
            fits = middle
        else:
            fails = middle
    return s[:fits]


def observation(text: str, most: int) -> str:
    """``text`` within ``most`` tokens (4 at least), with a mark if it was cut."""
    mark = "\n[truncated]"
    most = max(4, most)
    return text if count(text) <= most else cap(text, most - count(mark)) + mark


def cap_tokens(most: int):
    return by_row(lambda text: cap(text, most))


def cap_observation(most: int):
    return by_row(lambda text: observation(text, most))
