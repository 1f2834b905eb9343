"""Text functions as Column expressions, and Arrow UDFs where none will do.

Patterns are Unicode-aware (``(?iu)``), so that case folds Vietnamese letters.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions import lexicons as L
from weftgraph.functions.by_row import by_row

ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points, and one more for each astral one."""
    return F.length(text) + F.regexp_count(text, F.lit(ASTRAL))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def clean_hierarchy_name(name: Column, kind: str) -> Column:
    """Trimmed name if it starts with its kind's word and has at most 150
    UTF-16 units, else empty."""
    # The word that names of a kind start with.
    word = {"part": "phần", "chapter": "chương", "section": "mục", "subsection": "tiểu mục"}[kind]
    text = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(F.startswith(F.lower(text), F.lit(word)) & (utf16_length(text) <= 150), text).otherwise("")


def part_number(name: Column) -> Column:
    """Digits after "phần", else the first ordinal of the list, else 0."""
    digits = F.coalesce(F.nullif(F.regexp_extract(name, r"(?iu)phần (?:thứ )?([0-9]+)", 1), F.lit("")).cast("long"))
    out = F.lit(0).cast("long")
    for word, number in reversed(L.PART_ORDINALS):
        out = F.when(F.lower(name).contains(word), F.lit(number).cast("long")).otherwise(out)
    return F.coalesce(digits, out, F.lit(0).cast("long"))


def chapter_roman(name: Column) -> Column:
    """The numeral as written (upper-cased): roman if there is one, else digits;
    null without any."""
    roman = F.nullif(F.upper(F.regexp_extract(name, r"(?iu)chương\s+([IVXLCM]+)", 1)), F.lit(""))
    digits = F.nullif(F.regexp_extract(name, r"(?iu)chương\s+([0-9]+)", 1), F.lit(""))
    return F.coalesce(roman, digits)


def chapter_number(name: Column) -> Column:
    """Roman numerals up to 40; 0 for others; digits as they are; else null."""
    table = F.create_map(*[F.lit(x) for pair in L.roman_numerals().items() for x in pair])
    numeral = chapter_roman(name)
    return F.when(numeral.rlike("^[0-9]+$"), F.try_to_number(numeral, F.lit("999999999")).cast("long")).when(numeral.isNotNull(), F.coalesce(F.element_at(table, numeral).cast("long"), F.lit(0).cast("long")))


def section_number(name: Column, word: str = "mục") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, rf"(?iu){word}\s+([0-9]+):\s*(.+)", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))


def section_short_name(name: Column, word: str = "mục") -> Column:
    """What follows the number; a section loses commas at its end."""
    found = F.trim(F.regexp_extract(name, rf"(?iu){word}\s+([0-9]+):\s*(.+)", 2))
    if word == "mục":
        found = F.regexp_replace(found, ",+$", "")
    return F.when(F.regexp_like(name, F.lit(rf"(?iu){word}\s+([0-9]+):\s*(.+)")), found).otherwise(name)


def keywords(title: Column, content: Column) -> Column:
    """The legal terms that title and content contain, in the list's order."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))
    terms = F.array(*[F.lit(t) for t in L.LEGAL_TERMS])
    return F.filter(terms, lambda t: F.contains(text, t))


def article_references(text: Column) -> Column:
    """Distinct numbers after "điều", in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?iu)điều\s+([0-9]+)"), 1), lambda x: x.cast("long")))


def clause_references(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?iu)khoản\s+([0-9]+)"), 0), F.lower))


def point_references(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?iu)điểm\s+([{L.POINT_LETTERS.replace('đ', '')}])\)?"), 0), F.lower))


def render_template(title: Column, content: Column) -> Column:
    """Literal insertion: no sign in a text is special."""
    return F.concat(F.lit("title: "), F.coalesce(title, F.lit("")), F.lit(" | text: "), F.coalesce(content, F.lit("")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def count_tokens(text: Column) -> Column:
    """The larger of words and a quarter of the UTF-16 units, rounded up.
    Texts are taken as NFC; see ``nfc`` for others."""
    return F.greatest(word_count(text), F.ceil(utf16_length(text) / 4)).cast("long")


def estimate_input_tokens(text: Column) -> Column:
    return (F.length(text) + 3 * F.regexp_count(text, F.lit(ASTRAL))).cast("long")


def key_terms(text: Column) -> Column:
    """Distinct lower-case words of two letters or digits or more, without stop
    words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in L.KEY_TERM_STOPS]))


def query_tokens(text: str, least: int) -> list[str]:
    """Lower-case words of a query, of ``least`` letters or more; repeats stay."""
    return [w for w in text.lower().split() if len(w) >= least]


def keyword_score(text: Column, tokens: list[str]) -> Column:
    """How many of the tokens the lower-case text contains."""
    lower = F.lower(text)
    out = F.lit(0).cast("long")
    for token in tokens:
        out = out + F.when(lower.contains(token), 1).otherwise(0)
    return out


def route_query(query: Column) -> Column:
    """``local`` or ``global``, by ordered rules on words contained."""
    q = F.lower(query)
    return (
        F.when(contains_any(q, L.SHARED_TERMS), "local")
        .when(contains_any(q, L.SUMMARY_TERMS), "global")
        .when(contains_any(q, L.GLOBAL_TERMS) & ~contains_any(q, L.LOCAL_TERMS), "global")
        .otherwise("local")
    )


def concept_category(name: Column) -> Column:
    out = F.lit("other")
    for category, words in reversed(L.CONCEPT_CATEGORIES):
        out = F.when(contains_any(F.lower(name), words), category).otherwise(out)
    return out


def concept_id(name: Column) -> Column:
    return F.concat(F.lit("concept_"), F.regexp_replace(F.lower(name), r"\s+", "_"))


def truncated(text: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(suffix))).otherwise(text)


def valid_article_id(value: Column) -> Column:
    """``article_`` and a number; null is not."""
    return F.coalesce(F.regexp_like(value, F.lit(r"^article_[0-9]+\z")), F.lit(False))


def valid_query(value: Column, most: int = 1000) -> Column:
    """Something other than white space, of ``most`` UTF-16 units at most."""
    return F.coalesce(F.regexp_like(value, F.lit(r"(?U)\S")) & (utf16_length(value) <= most), F.lit(False))


def valid_level(value: Column) -> Column:
    """A whole number from 0 (part) to 3 (subsection)."""
    return F.coalesce((value == F.floor(value)) & value.between(0, 3), F.lit(False))


def error_class(message: Column) -> Column:
    """Code of an error by the first pattern that its text has."""
    # Patterns and codes, in order.
    rules = (
        (r"(?i)aborted", "aborted"),
        (r"(?i)\b429\b|RESOURCE_EXHAUSTED|rate.?limit|quota", "llm_rate_limited"),
        (r"(?i)\b(401|403)\b|API key|PERMISSION_DENIED|UNAUTHENTICATED", "llm_auth_error"),
        (r"(?i)\b400\b|INVALID_ARGUMENT", "llm_error"),
        (r"(?i)fetch failed|ECONN|ENOTFOUND|ETIMEDOUT|network|\b50[034]\b", "llm_unreachable"),
    )
    out = F.lit("internal")
    for pattern, code in reversed(rules):
        out = F.when(F.regexp_like(message, F.lit(pattern)), code).otherwise(out)
    return out


def names_article(text: Column, number: int) -> Column:
    """Whether the text names that article and not one whose number goes on."""
    return F.regexp_like(text, F.lit(rf"(?iu)điều\s*{number}(?![0-9])"))


def markdown_emphasis(text: Column) -> Column:
    """Marks articles, clauses and points bold, chapters and sections italic."""
    # What is marked, and how.
    for pattern, to in (
        (r"(?iu)điều ([0-9]+)", "**Điều $1**"),
        (r"(?iu)khoản ([0-9]+)", "**khoản $1**"),
        (r"(?iu)điểm ([a-zđ])(?![\p{L}0-9_])", "**điểm $1**"),
        (r"(?iu)chương ([ivx]+)", "_Chương $1_"),
        (r"(?iu)tiểu mục ([0-9]+)", "_Tiểu mục $1_"),
        (r"(?iu)(?<!tiểu )mục ([0-9]+)", "_Mục $1_"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def is_section_heading(line: Column) -> Column:
    t = F.trim(line)
    heading = t.rlike(r"^#{1,4}\s+.+$")
    numbered = t.rlike(r"^[0-9]+\.\s+(\*\*[^*]+\*\*|[A-ZÀ-Ỹ0-9][^:.\n]{2,80}:?)$")
    bold = F.regexp_like(t, F.lit(r"(?iu)^\*\*([0-9]+\.\s+[^:*]+|Phần\s+[^:*]+|Chương\s+[^:*]+|Điều\s+[^:*]+)\*\*:?$"))
    plain = (t == "") | t.rlike(r"^[-*_]{3,}$") | F.startswith(t, F.lit("```"))
    return ~plain & (heading | numbered | bold)


def section_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), is_section_heading)).cast("long")


def escape_tool_output(text: Column, tag: str = "tool_output") -> Column:
    """Breaks closing tags of the wrapper, in any case and spacing."""
    return F.regexp_replace(text, rf"(?i)<\s*/\s*{tag}\s*>", f"<\\\\/{tag}>")


@by_row
def nfc(text: str) -> str:
    """Unicode NFC; Spark has no function for it."""
    return unicodedata.normalize("NFC", text)


def _phrases(*names: str) -> str:
    """Phrases of the named lists as one pattern: a word in braces stands for a
    list of its own, and a space for any white space where the list says so."""

    def expanded(name: str) -> str:
        spaced, phrases = L.RECALL_PHRASES[name]
        parts = []
        for phrase in phrases:
            for inner in L.RECALL_PHRASES:
                if "{" + inner + "}" in phrase:
                    phrase = phrase.replace("{" + inner + "}", f"(?:{expanded(inner)})")
            parts.append(phrase.replace(" ", r"\s+") if spaced else phrase)
        return "|".join(parts)

    return "|".join(map(expanded, names))


def _has(text: Column, *names: str) -> Column:
    """Whether a phrase of the lists stands in the text between other than letters."""
    return F.regexp_like(text, F.lit(rf"(?iu)(?<!\p{{L}})(?:{_phrases(*names)})(?!\p{{L}})"))


def _recall_intent(text: Column) -> Column:
    ends = F.regexp_like(text, F.lit(rf"(?iu)(?<!\p{{L}})(?:{_phrases('before')})\s*[?!.…]*\s*$"))
    return _has(text, "conversation_vi", "conversation_en", "first_marked", "first_en") | (ends & _has(text, "context"))


def recall_intent(text: Column) -> Column:
    """Whether a message (taken as NFC) refers to the conversation itself."""
    return _recall_intent(nfc(text))


def is_first_key(text: Column) -> Column:
    """Whether a key (in NFC) names the first question."""
    bare = F.regexp_like(text, F.lit(rf"(?iu)^\s*(?:{_phrases('first_bare')})\s*[?!.…]*\s*$"))
    return bare | _has(text, "first_key", "first_en", "first_thing")


def is_recent_key(text: Column) -> Column:
    """Whether a key (in NFC) names the recent turns."""
    return ~is_first_key(text) & _has(text, "recent_vi", "before", "earlier", "conversation_en")


class _Unmarked(dict):
    """Code points to themselves, marks to nothing; filled as they occur."""

    def __missing__(self, point: int) -> int | None:
        self[point] = None if unicodedata.category(chr(point)) == "Mn" else point
        return self[point]


_UNMARKED = _Unmarked()


@by_row
def folded(text: str) -> str:
    """Lower case without diacritics."""
    s = text.lower()
    return s if s.isascii() else unicodedata.normalize("NFD", s.replace("đ", "d")).translate(_UNMARKED)
