"""Filter interaction audit by inclusion and exclusion, in DataFrame functions.

Every document fails some subset of the filters.  One pass counts, for each
part, how many documents fail all filters of each of the 32 intersections; all
that an order of filters does to a part follows from those counts.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_WHITE = r"[\x20\x09-\x0D]+"


def short(words: Column, text: Column, least: int = 200) -> Column:
    """Under ``least`` words."""
    return F.size(words) < least


def repetitive(words: Column, text: Column, percent: int = 50) -> Column:
    """Distinct words are under ``percent`` of all; never so without words."""
    return 100 * F.size(F.array_distinct(words)).cast("long") < percent * F.size(words).cast("long")


def shouting(words: Column, text: Column, percent: int = 2) -> Column:
    """A-Z are over ``percent`` of the code points."""
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > percent * F.length(text).cast("long")


def marked(words: Column, text: Column, marks: str = "#$%&*|") -> Column:
    """Holds any of the marks."""
    return F.rlike(text, F.lit(f"[{marks}]"))


#: The filters that see one text alone, by letter; the last letter, E, is that of copies.
FILTERS = {"A": short, "B": repetitive, "C": shouting, "D": marked}
LETTERS = "".join(FILTERS) + "E"


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the set of filters that they
    fail (bit i: the letter i) and by their labels.

    A null text is empty, a null part the empty string.  A document fails E if
    its text stands under a smaller id anywhere in the table; a null id is
    smaller than none and has none smaller, and of rows with one id and one text
    none is smaller.  Repeated rows count each; several labels of one id count
    as one that has what any has; an empty table gives no rows.

    The scan keeps a digest of the text and some bits.  Rows are counted by
    (text, id) and then by (text, part, labels), so that a text with very many
    copies is a few rows before its least id is looked for.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    worded = picked.withColumn("words", F.array_remove(F.split("text", _WHITE), ""))
    bits = [F.when(fails(F.col("words"), F.col("text")), 1 << i).otherwise(0) for i, fails in enumerate(FILTERS.values())]
    narrow = worded.select("id", "part", sum(bits[1:], bits[0]).alias("mask"), F.unhex(F.sha2("text", 256)).alias("key"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    of = ["part", "mask", "good", "toxic"]
    marked_rows = narrow.join(known, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    by_id = marked_rows.groupBy("key", "id", *of).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    by_text = by_id.groupBy("key", *of).agg(least, F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unknown"))
    first = F.min("least.id").over(W.partitionBy("key"))
    found = by_text.withColumn("passing", F.col("unknown") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0))
    copied = 1 << len(FILTERS)
    split = F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + copied).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    counted = found.select("part", "good", "toxic", F.explode(split).alias("x")).where("x.n > 0")
    return counted.groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def joint_counts(failed: DataFrame, k: int) -> DataFrame:
    """(part, joint, joint_good, joint_toxic): for each set of filters, bit by
    bit, how many documents fail all of them, whatever else they fail.  A
    document counts by the product of its flags; the empty product is 1."""

    def counted(also: str) -> Column:
        return F.expr(f"array({', '.join(f'sum(CASE WHEN (mask & {s}) = {s}{also} THEN n ELSE 0L END)' for s in range(1 << k))})")

    return failed.groupBy("part").agg(counted("").alias("joint"), counted(" AND good").alias("joint_good"), counted(" AND toxic").alias("joint_toxic"))


def _signed(joint: str, sets: list[tuple[int, int]]) -> str:
    """A sum of joint counts, as SQL: (set, factor)."""
    return " + ".join(f"{joint}[{s}] * ({factor}L)" for s, factor in sets)


def _listed(sums: Iterable[str]) -> Column:
    return F.expr(f"array({', '.join(sums)})")


def survivors(joint: str, k: int) -> Column:
    """How many pass all of each set of filters: the Möbius inversion, in which a
    subset of an odd size takes away."""
    return _listed(_signed(joint, [(s, (-1) ** s.bit_count()) for s in range(1 << k) if s & p == s]) for p in range(1 << k))


def audit(failed: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What each step of each order of the filters does, by part.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.  ``failed`` is as ``failures`` gives it, with a
    bit for each letter.  A game whose worth is the number of documents that a set
    of filters removes has the joint counts as its Harsanyi dividends, with the
    sign of an even set turned; a filter's Shapley value shares each dividend
    among its members, here times the number of orders, which makes it whole.

    A part whose documents fail nothing has zeros; no documents give no rows.
    """
    k, orders = len(letters), factorial(len(letters))
    having = [[s for s in range(1 << k) if s >> i & 1] for i in range(k)]
    sums = joint_counts(failed, k).select(
        "part", *[survivors(f"joint{x}", k).alias(f"kept{x}") for x in ("", "_good", "_toxic")],
        _listed(f"joint[{1 << i}]" for i in range(k)).alias("fails"),
        _listed(_signed("joint", [(s, (-1) ** (s.bit_count() - 1)) for s in having[i]]) for i in range(k)).alias("unique"),
        _listed(_signed("joint", [(s, (-1) ** (s.bit_count() + 1) * (orders // s.bit_count())) for s in having[i]]) for i in range(k)).alias("shapley"),
    )
    bit_of = F.create_map(*[F.lit(x) for i, letter in enumerate(letters) for x in (letter, 1 << i)])
    ordered = sums.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(map("".join, permutations(letters)))), " ")))
    bits = ordered.withColumn("bits", F.transform(F.split("filter_order", ""), lambda x: bit_of[x]))
    steps = bits.select("*", F.posexplode("bits").alias("place", "bit"))
    done = F.aggregate(F.slice("bits", F.lit(1), F.col("place")), F.lit(0), lambda x, y: x + y)
    at = steps.withColumns({"step": F.col("place") + 1, "done": done, "i": F.instr(F.lit(letters), F.substring("filter_order", F.col("place") + 1, F.lit(1))) - 1})
    now = F.col("done") + F.col("bit")
    lost = lambda kept: F.get(kept, F.col("done")) - F.get(kept, now)
    return at.select(
        "part", "filter_order", "step", F.get("kept", now).alias("kept"), lost("kept").alias("removed"), (F.get("fails", F.col("i")) - lost("kept")).alias("redundant"),
        F.get("unique", F.col("i")).alias("unique_fails"), lost("kept_good").alias("good_lost"), lost("kept_toxic").alias("toxic_lost"), F.get("shapley", F.col("i")).alias("shapley"),
    )
