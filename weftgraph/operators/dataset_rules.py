"""The rules of an evaluation dataset, as data: evaluated in one scan of the cases."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types of cases, routes of turns, characters of a query at most.
TYPES = ("seed", "multi_hop", "explicit_article", "global", "small_talk", "recall_basic", "recall_fresh", "recall_far", "followup_window", "isolation", "false_trigger")
ROUTES = ("legal", "recall", "smalltalk")
MOST_CHARS, FAR_TURNS = 1000, 11

CASE = (
    "id string, type string, turns array<struct<session:string,query:string,route:string>>, gold array<bigint>, chapter struct<label:string,first:bigint,last:bigint>, first_tool string, answer_names array<bigint>, "
    "recall_target int, leak_markers array<string>"
)


@dataclass(frozen=True)
class Rule:
    """What must hold: of each turn (``turn``: the condition takes one), or of the
    case; for cases of some ``types`` or, without, of any valid one."""

    id: str
    holds: Callable[..., Column]
    types: tuple[str, ...] = ()
    turn: bool = False


def _size(column: str) -> Column:
    return F.coalesce(F.size(column), F.lit(0))


def _turn(at: int) -> Column:
    return F.get("turns", F.lit(at))


def _numbers(text: Column) -> Column:
    """Numbers of the articles that a text names, as written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"Điều\s+([0-9]+)"), 1)


def _names(text: Column, number: Column) -> Column:
    return F.array_contains(_numbers(text), number.cast("string"))


def _first_query() -> Column:
    return F.coalesce(_turn(0)["query"], F.lit(""))


def _routed(at: int, route: str) -> Column:
    return _turn(at)["route"] == route


def _one_gold() -> Column:
    """The first gold article as the corpus has it: number, title, content."""
    return F.get(F.filter("cited", lambda a: a["number"] == F.get("gold", F.lit(0))), F.lit(0))


def _edge() -> Column:
    return F.exists("cited", lambda a: F.exists("gold", lambda b: (a["number"] != b) & _names(a["content"], b)))


def _chapter_title() -> Column:
    rest = F.regexp_extract(F.col("span.title"), r"(?s)^[^:]*:(.*)$", 1)
    return F.lower(F.regexp_replace(F.trim(rest), r"[,.\s]+$", ""))


#: What the rules need of a case stands in its columns: ``cited`` (its gold
#: articles that the corpus has) and ``span`` (of its chapter there).
RULES = (
    Rule("invalid_route", lambda t: t["route"].isin(*ROUTES), turn=True),
    Rule("query_length", lambda t: F.length(t["query"]).between(1, MOST_CHARS), turn=True),
    Rule("no_session", lambda t: F.length(t["session"]) > 0, turn=True),
    Rule("gold_missing", lambda: F.col("gold").isNotNull()),
    Rule("unknown_article", lambda: F.forall(F.coalesce("gold", F.array().cast("array<bigint>")), lambda g: F.exists("cited", lambda a: a["number"] == g))),
    Rule("seed_shape", lambda: (_size("turns") == 1) & (_size("gold") >= 1), ("seed",)),
    Rule("two_gold", lambda: _size("gold") >= 2, ("multi_hop",)),
    Rule("no_reference_edge", _edge, ("multi_hop",)),
    Rule("first_tool", lambda: F.col("first_tool") == "traverse_references", ("multi_hop",)),
    Rule("one_gold", lambda: _size("gold") == 1, ("explicit_article",)),
    Rule("query_names_gold", lambda: _names(_first_query(), F.get("gold", F.lit(0))), ("explicit_article",)),
    Rule("corpus_title", lambda: F.startswith(_one_gold()["title"], F.concat(F.lit("Điều "), F.get("gold", F.lit(0)).cast("string"), F.lit("."))), ("explicit_article",)),
    Rule("first_tool", lambda: F.col("first_tool") == "get_article", ("explicit_article",)),
    Rule("gold_chapter", lambda: F.col("chapter").isNotNull(), ("global",)),
    Rule("no_gold", lambda: _size("gold") == 0, ("global",)),
    Rule("first_tool", lambda: F.col("first_tool") == "get_community_context", ("global",)),
    Rule("unknown_chapter", lambda: F.col("chapter").isNull() | F.col("span").isNotNull(), ("global",)),
    Rule("chapter_span", lambda: F.col("span").isNull() | ((F.col("span.lo") == F.col("chapter.first")) & (F.col("span.hi") == F.col("chapter.last"))), ("global",)),
    Rule("chapter_gap", lambda: F.col("span").isNull() | (F.col("span.hi") - F.col("span.lo") + 1 == F.col("span.n")), ("global",)),
    Rule("chapter_title", lambda: F.col("span").isNull() | ((_chapter_title() != "") & F.contains(F.lower(_first_query()), _chapter_title())), ("global",)),
    Rule("small_talk_shape", lambda: (_size("gold") == 0) & _routed(0, "smalltalk"), ("small_talk",)),
    Rule("recall_turn", lambda: (_size("turns") == 2) & _routed(1, "recall"), ("recall_basic",)),
    Rule("answer_names", lambda: _size("answer_names") > 0, ("recall_basic",)),
    Rule("query_names_answer", lambda: F.forall(F.coalesce("answer_names", F.array().cast("array<bigint>")), lambda n: _names(_first_query(), n)), ("recall_basic",)),
    Rule("recall_turn", lambda: (_size("turns") == 1) & _routed(0, "recall"), ("recall_fresh",)),
    Rule("far_turns", lambda: _size("turns") == FAR_TURNS, ("recall_far",)),
    Rule("recall_turn", lambda: F.element_at("turns", -1)["route"] == "recall", ("recall_far",)),
    Rule("recall_target", lambda: F.col("recall_target") == 0, ("recall_far",)),
    Rule("repeated_query", lambda: F.size(F.array_distinct(F.transform("turns", lambda t: t["query"]))) == F.size("turns"), ("recall_far",)),
    Rule("followup_shape", lambda: (_size("turns") == 2) & (_size("gold") >= 2), ("followup_window",)),
    Rule("legal_turns", lambda: F.forall("turns", lambda t: t["route"] == "legal"), ("followup_window",)),
    Rule("two_sessions", lambda: (_size("turns") == 2) & (_turn(0)["session"] == "A") & (_turn(1)["session"] == "B"), ("isolation",)),
    Rule("leak_markers", lambda: _size("leak_markers") > 0, ("isolation",)),
    Rule("marker_in_query", lambda: F.forall(F.coalesce("leak_markers", F.array().cast("array<string>")), lambda m: F.contains(_first_query(), m)), ("isolation",)),
    Rule("trigger_shape", lambda: (_size("turns") == 1) & _routed(0, "legal"), ("false_trigger",)),
)


def prepared(cases: DataFrame, corpus: DataFrame) -> DataFrame:
    """Cases with ``cited`` and ``span``.  ``corpus``: number, title, content, chapter.

    Gold numbers meet the corpus in a join, and come back as one small list a
    case; chapters are aggregated once.
    """
    names = [x.split()[0] for x in CASE.split(", ")]
    rows = cases.select(F.struct(*names).alias("case")).groupBy("case").agg(F.count("*").alias("copies"))
    gold = rows.select("case", "copies", F.explode_outer("case.gold").alias("number"))
    known = gold.join(corpus.select("number", F.struct("number", "title", "content").alias("article")), "number", "left")
    cited = known.groupBy("case", "copies").agg(F.collect_list("article").alias("cited"))
    label = F.regexp_extract("chapter", r"(?s)^Chương ([^:]*):", 1)
    spans = corpus.where(F.rlike("chapter", F.lit(r"(?s)^Chương [^:]*:"))).groupBy(label.alias("label")).agg(F.struct(F.min("number").alias("lo"), F.max("number").alias("hi"), F.count("*").alias("n"), F.min_by("chapter", "number").alias("title")).alias("span"))
    both = cited.join(spans, F.col("case.chapter.label") == F.col("label"), "left")
    return both.select("case.*", "cited", "span", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def broken_rules(cases: DataFrame, corpus: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, subject, turn) for each rule that a case breaks; ``turn`` counts
    from 0 and is null for rules of whole cases.

    A case of an unknown type, and then one without turns, breaks that rule and
    isn't looked at further, but for a missing id.  A condition that is null is broken.
    """
    kind, none = F.col("type"), F.lit(None).cast("int")
    valid, asked = F.coalesce(kind.isin(*TYPES), F.lit(False)), _size("turns") > 0

    def found(rule: Rule) -> Column:
        applies = valid & asked & (kind.isin(*rule.types) if rule.types else F.lit(True))
        if rule.turn:
            turns = F.filter(F.transform("turns", lambda t, i: F.when(~F.coalesce(rule.holds(t), F.lit(False)), i)), lambda i: i.isNotNull())
            return F.when(applies, F.transform(turns, lambda i: F.struct(F.lit(rule.id).alias("rule"), i.alias("turn"))))
        return F.when(applies & ~F.coalesce(rule.holds(), F.lit(False)), F.array(F.struct(F.lit(rule.id).alias("rule"), none.alias("turn"))))

    first = {"no_id": F.coalesce(F.col("id"), F.lit("")) == "", "invalid_type": ~valid, "no_turns": valid & ~asked}
    own = [F.when(cond, F.array(F.struct(F.lit(name).alias("rule"), none.alias("turn")))) for name, cond in first.items()]
    every = F.flatten(F.filter(F.array(*own, *map(found, rules)), lambda x: x.isNotNull()))
    return prepared(cases, corpus).select("id", F.explode(every).alias("x")).select("x.rule", F.col("id").alias("subject"), "x.turn")


def broken_routes(cases: DataFrame, recalls: Callable[[Column], Column]) -> DataFrame:
    """(rule, subject, turn) of turns whose route is recall but whose query asks for
    none, or the other way round; ``recalls`` is ``text.recall_intent``, which
    takes rows, not items of an array."""
    rows = cases.where(F.col("type").isin(*TYPES)).select("id", F.posexplode("turns").alias("turn", "t")).where(F.length("t.query") > 0)
    agrees = recalls(F.col("t.query")) == F.coalesce(F.col("t.route") == "recall", F.lit(False))
    return rows.where(~agrees).select(F.lit("route_intent").alias("rule"), F.col("id").alias("subject"), "turn")


def broken_totals(cases: DataFrame, declared: DataFrame, total: int) -> DataFrame:
    """(rule, subject, turn) of the whole dataset: repeated ids, once for each
    repetition; types whose number differs from the declared one (``declared``:
    type, n); and the declared total."""
    none = F.lit(None).cast("int").alias("turn")
    repeated = cases.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("rule"), F.col("id").alias("subject"), F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))).alias("i")).select("rule", "subject", none)
    spark = cases.sparkSession
    types = spark.createDataFrame([(t,) for t in TYPES], "type string")
    counts = types.join(cases.groupBy("type").agg(F.count("*").alias("have")), "type", "left").join(declared.select("type", F.col("n").alias("want")), "type", "left")
    counts = counts.where(F.coalesce("have", F.lit(0)) != F.coalesce("want", F.lit(0))).select(F.lit("count").alias("rule"), F.col("type").alias("subject"), none)
    whole = cases.agg(F.count("*").alias("n")).where(F.col("n") != total).select(F.lit("total").alias("rule"), F.lit(None).cast("string").alias("subject"), none)
    return repeated.union(counts).union(whole)
