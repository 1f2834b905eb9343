"""Fill-in-the-middle: texts cut in three and put in another order."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: A unit of text: a line with its end, or a last line without one.
LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Middle:
    """How texts are cut: the seed's name, how many in a hundred are changed, how
    many of those have the suffix first, and the marks of the three parts."""

    seed: str = "7"
    rate: int = 100
    suffix_first: int = 50
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    def draws(self, doc_id: str | None) -> list[int]:
        """Four numbers of 32 bits from the hash of seed and id."""
        digest = hashlib.sha256(f"{self.seed}:{doc_id or ''}".encode()).hexdigest()
        return [int(digest[at : at + 8], 16) for at in (0, 8, 16, 24)]

    def apply(self, doc_id: str | None, text: str, ends_of: Callable[[str], array]) -> tuple[int, str, int | None, int | None, str]:
        """(units, form, characters of the prefix, of the middle, output)."""
        ends = ends_of(text)
        n = len(ends)
        one, two, chance, kind = self.draws(doc_id)
        if not text or any(x in text for x in (self.prefix_mark, self.suffix_mark, self.middle_mark)) or chance % 100 >= self.rate:
            return n, "plain", None, None, text
        first, second = sorted((one % (n + 1), two % (n + 1)))
        a, b = ends[first - 1] if first else 0, ends[second - 1] if second else 0
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if kind % 100 < self.suffix_first:
            return n, "spm", a, b - a, f"{self.suffix_mark}{suffix}{self.prefix_mark}{prefix}{self.middle_mark}{middle}"
        return n, "psm", a, b - a, f"{self.prefix_mark}{prefix}{self.suffix_mark}{suffix}{self.middle_mark}{middle}"

    def restored(self, output: str, form: str) -> str:
        """The text of an output.  No text that was changed holds a mark, and none
        of the marks overlaps itself or another, so the first of each is the one
        that was put in."""
        if form == "plain":
            return output
        front, back = (self.suffix_mark, self.prefix_mark) if form == "spm" else (self.prefix_mark, self.suffix_mark)
        one, _, rest = output[len(front) :].partition(back)
        two, _, middle = rest.partition(self.middle_mark)
        prefix, suffix = (two, one) if form == "spm" else (one, two)
        return prefix + middle + suffix


def unit_ends(pattern: str) -> Callable[[str], array]:
    """The end of each unit of a text, in code points, as a compact array."""
    find = regex.compile(pattern).finditer
    return lambda text: array("q", (m.end() for m in find(text)))


def fill_in_middle(docs: DataFrame, middle: Middle = Middle(), unit: str = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text with its
    middle moved to the end.

    A text is cut into ``n`` units; the prefix ends after one number of units
    that the seed draws, the middle after another.  ``form`` is ``psm``, ``spm``
    (suffix first) or ``plain``: unchanged, for an empty text, one that holds a
    mark, or one that the rate leaves out; a plain row has null lengths.  A null
    text is empty; a null id draws as an empty one; repeated rows come out alike;
    an empty table gives no rows.  Rows are independent, so there is no shuffle.
    """

    @pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        ends_of = unit_ends(unit)
        rows = [middle.apply(i, t, ends_of) for i, t in zip(ids, texts, strict=True)]
        n, form, prefix, inner, output = zip(*rows, strict=True) if rows else ([],) * 5
        return pd.DataFrame({"n": n, "form": form, "prefix_chars": pd.array(prefix, dtype="Int64"), "middle_chars": pd.array(inner, dtype="Int64"), "output": output})

    done = docs.select(F.col(id_col), cut(F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("cut"))
    return done.select(F.col(id_col), "cut.*")


def digests(output: Column, form: Column, middle: Middle = Middle()) -> Column:
    """struct<output_sha256, restored_sha256> of an output and the text that is
    rebuilt from it."""

    @pandas_udf("output_sha256 string, restored_sha256 string")
    def hashed(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        return pd.DataFrame({"output_sha256": [digest(x) for x in outputs], "restored_sha256": [digest(middle.restored(x, f)) for x, f in zip(outputs, forms, strict=True)]})

    return hashed(output, form)
