"""Evaluation statistics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import lexicons as L
from weftgraph.session import dealt


def rate(k: Column, n: Column) -> Column:
    """k / n; null where there is nothing."""
    return F.try_divide(k.cast("double"), n.cast("double"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k in n, within 0 and 1; nulls for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = rate(k, n)
    d = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def nearest_rank(column: str, p: float) -> Column:
    """The value at rank max(1, ceil(p n)): discrete, not interpolated."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def rule_of_three(n: Column) -> Column:
    return F.try_divide(F.lit(3.0), n)


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    return F.try_divide(F.size(F.array_intersect(F.slice(ranked, 1, k), gold)).cast("double"), F.size(F.array_distinct(gold)).cast("double"))


def reciprocal_rank(ranked: Column, gold: Column) -> Column:
    """1 / place of the first hit, else 0."""
    places = F.filter(F.transform(gold, lambda g: F.array_position(ranked, g)), lambda x: x > 0)
    return F.coalesce(F.try_divide(F.lit(1.0), F.array_min(places).cast("double")), F.lit(0.0))


def ranked_list(seeds: Column, paths: Column) -> Column:
    return F.array_distinct(F.concat(seeds, paths))


def citation_recall(citations: DataFrame, gold: DataFrame) -> DataFrame:
    """(case_id, recall) of gold articles among those cited; null without gold."""
    cited = citations.groupBy("case_id").agg(F.collect_set("article").alias("cited"))
    wanted = gold.groupBy("case_id").agg(F.collect_set("article").alias("gold"))
    return cited.join(wanted, "case_id", "full_outer").select("case_id", F.try_divide(F.size(F.array_intersect(F.coalesce("cited", F.array().cast("array<bigint>")), "gold")).cast("double"), F.nullif(F.size("gold"), F.lit(0))).alias("recall"))


def arm_deltas(scores: DataFrame, arm: str, value: str, base: str) -> DataFrame:
    """Mean of each arm, and what it is more than the base arm's."""
    means = scores.groupBy(F.col(arm).alias("arm")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return means.crossJoin(F.broadcast(means.where(F.col("arm") == base).select(F.col("mean").alias("_b")))).withColumn("delta", F.col("mean") - F.col("_b")).drop("_b")  # one row


def kpi_rates(scores: DataFrame, kpis: list[str]) -> DataFrame:
    """(kpi, k, n, rate, low, high): of the cases that a flag applies to (not
    null); a case with an error stays in n, and in k if its flag says so."""
    flags = F.explode(F.array(*[F.struct(F.lit(x).alias("kpi"), F.col(x).cast("boolean").alias("flag")) for x in kpis])).alias("f")
    sums = scores.select(flags).where("f.flag is not null").groupBy("f.kpi").agg(F.sum(F.col("f.flag").cast("long")).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return sums.select("kpi", "k", "n", rate(F.col("k"), F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def paired_deltas(agent: DataFrame, legacy: DataFrame) -> DataFrame:
    """Recall and latency of one case in both arms.  Cases that failed in the
    legacy arm are left out; failures of the agent score 0, and then there is no
    95th percentile."""
    a = agent.select("case_id", F.when(F.col("error"), 0.0).otherwise(F.col("recall")).alias("a"), F.col("ms").alias("a_ms"), F.col("error").alias("a_error"))
    b = legacy.where(~F.col("error")).select("case_id", F.col("recall").alias("b"), F.col("ms").alias("b_ms"))
    p95 = lambda c: nearest_rank(c, 0.95)
    out = a.join(b, "case_id").agg(F.count("*").alias("n"), F.avg("a").alias("agent"), F.avg("b").alias("legacy"), p95("a_ms").alias("_p"), p95("b_ms").alias("legacy_p95"), F.coalesce(F.max("a_error"), F.lit(False)).alias("_e"))
    return out.select("n", "agent", "legacy", (F.col("agent") - F.col("legacy")).alias("delta"), F.when(~F.col("_e"), F.col("_p")).alias("agent_p95"), "legacy_p95")


def gate(value: Column, op: Column, target: Column) -> Column:
    """PASS, FAIL or NOT MEASURED, with a slack of 1e-9."""
    ok = F.when(op == ">=", value >= target - 1e-9).when(op == "<=", value <= target + 1e-9).when(op == "==", F.abs(value - target) <= 1e-9)
    return F.when(value.isNull(), "NOT MEASURED").when(ok, "PASS").otherwise("FAIL")


def cost_estimate(turns: DataFrame, steps: int, legacy_calls: int, per_call: int = 7000, per_legacy: int = 2500) -> DataFrame:
    """Turns by route and the tokens they may take at most, from one row a turn
    (case_id, route).  A legal turn takes steps + 1 calls, a recall two, and any
    other route counts as small talk: one.  ``legacy_calls`` are given."""
    of = lambda cond: F.count_if(cond)
    legal, recall = F.coalesce(F.col("route") == "legal", F.lit(False)), F.coalesce(F.col("route") == "recall", F.lit(False))
    sums = turns.agg(F.countDistinct("case_id").alias("cases"), F.count("*").alias("turns"), of(legal).alias("legal_turns"), of(recall).alias("recall_turns"), of(~legal & ~recall).alias("smalltalk_turns"))
    calls = F.col("legal_turns") * (steps + 1) + F.col("recall_turns") * 2 + F.col("smalltalk_turns")
    return sums.withColumns({"legacy_calls": F.lit(legacy_calls).cast("long"), "estimated_tokens": (calls * per_call + legacy_calls * per_legacy).cast("long")})


def embedding_plan(docs: DataFrame, batch: int = 100, usd_per_million: float = 0.20) -> DataFrame:
    """Per kind: batches, the longest text's tokens, and the cost."""
    sums = docs.groupBy("kind").agg(F.count("*").alias("n"), F.max("est_tokens").alias("max_tokens"), F.sum(F.ceil(F.col("chars") / 4)).alias("tokens"))
    return sums.select("kind", "n", F.ceil(F.col("n") / batch).cast("long").alias("batches"), "max_tokens", F.col("tokens").cast("long").alias("tokens"), (F.col("tokens") * usd_per_million / 1e6).alias("usd"))


def first_mismatch(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """The first of the fields in which two one-row manifests differ, or null."""
    out = F.lit(None).cast("string")
    for f in reversed(fields):
        out = F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f).otherwise(out)
    return a.alias("a").crossJoin(b.alias("b")).select(out.alias("mismatch"))


def fingerprint_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change): files that changed, are missing, or appeared."""
    both = before.select("name", F.struct("size", "sha256").alias("x")).join(after.select("name", F.struct("size", "sha256").alias("y")), "name", "full_outer")
    change = F.when(F.col("x").isNull(), "appeared").when(F.col("y").isNull(), "missing").when(F.col("x") != F.col("y"), "changed")
    return both.select("name", change.alias("change")).where("change is not null")


def plain(text: Column) -> Column:
    """Lower case, with runs of blanks as one; NFC is the caller's."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def valid_call(tool: Column, arguments: Column) -> Column:
    """Whether a tool is known and its JSON holds one of the arguments that it
    needs: a positive whole ``article_number``, or another as a text that isn't empty."""
    found = F.try_parse_json(arguments)
    number = F.try_variant_get(found, "$.article_number", "double")
    is_number = ~F.coalesce(F.schema_of_variant(F.try_variant_get(found, "$.article_number", "variant")).isin("STRING", "BOOLEAN"), F.lit(True))

    def fits(name: str) -> Column:
        if name == "article_number":
            return is_number & (number > 0) & (number == F.floor(number))
        kind = F.schema_of_variant(F.try_variant_get(found, f"$.{name}", "variant"))
        return (kind == "STRING") & (F.length(F.try_variant_get(found, f"$.{name}", "string")) > 0)

    out = F.lit(False)
    for name, wanted in L.TOOL_ARGUMENTS:
        for argument in wanted:
            out = out | ((tool == name) & F.coalesce(fits(argument), F.lit(False)))
    return F.coalesce(out, F.lit(False))


def quoted_queries(answers: DataFrame, queries: DataFrame, least: int = 12) -> DataFrame:
    """case_id of ``answers`` (case_id, answer) that hold a query of ``least``
    characters or more.  Beginnings of queries meet equally long windows of the
    answers in an equal join; whole queries are compared after it."""
    asked = queries.where(F.length("query") >= least).select(plain(F.col("query")).alias("q")).distinct()
    asked = asked.select("q", F.substring("q", 1, least).alias("key"))
    lengths = asked.select(F.length("key").alias("n")).distinct()  # at most least + 1 rows
    texts = answers.select("case_id", plain(F.col("answer")).alias("a"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("a") - F.col("n") + 1, F.lit(1)))
    keys = F.array_distinct(F.transform(starts, lambda at: F.substring(F.col("a"), at, F.col("n"))))
    # Windows travel without their answer; the few that begin a query meet it again.
    windows = texts.join(F.broadcast(lengths)).select("case_id", F.explode(keys).alias("key"))
    possible = windows.join(asked, "key").select("case_id", "q").distinct()
    return possible.join(texts, "case_id").where(F.contains("a", F.col("q"))).select("case_id").distinct()


def case_scores(cases: DataFrame, turns: DataFrame, max_steps: int) -> DataFrame:
    """Score of each case by its type (one of ``CASE_TYPES``).

    ``cases``: case_id, type, queries (texts of its turns), gold (articles),
    chapter (label, first, last), expected_first_tool, answer_names (articles),
    leaks (texts that another session mustn't show), target_turn.  ``turns``: one
    row for each attempted turn: case_id, turn (from 0), ok, answer and steps
    (kind, tool, tool_input, content, citations (article, breadcrumb)).

    A case with a failed or missing turn is ``errored`` and has calls only.  One
    turn is scored: the last of follow-ups, isolation and recalls but fresh
    ones, else the first.  Flags that don't apply to a type are null.  Texts are
    compared by ``plain``.  Null steps, answers and lists are empty; with a null type
    no flag applies.
    """
    kind, last = F.col("type"), F.size("queries") - 1
    own = cases.select("*", F.when(kind.isin("followup_window", "recall_basic", "recall_far", "isolation"), last).otherwise(0).alias("scored"))
    steps = F.coalesce("steps", F.array().cast(turns.schema["steps"].dataType))
    actions = F.filter(steps, lambda s: s["kind"] == "action")
    seen = F.filter(steps, lambda s: s["kind"] == "observation")
    recalls = F.transform(steps, lambda s: F.coalesce((s["kind"] == "action") & (s["tool"] == "recall_session"), F.lit(False)))
    at = F.array_position(recalls, True).cast("int")
    after = F.filter(F.slice(steps, at + 1, F.size(steps)), lambda s: s["kind"] == "observation")
    facts = F.struct(
        "turn",
        F.coalesce("answer", F.lit("")).alias("answer"),
        F.get(actions, F.lit(0))["tool"].alias("first_tool"),
        F.size(actions).alias("calls"),
        (at > 0).alias("recalled"),
        F.when(at > 0, F.get(after, F.lit(0))["content"]).alias("recall"),
        F.flatten(F.filter(F.transform(seen, lambda s: s["citations"]), lambda x: x.isNotNull())).alias("cited"),
        F.array_join(F.transform(steps, lambda s: s["content"]), "\n").alias("contents"),
    )
    invalid = F.size(F.filter(actions, lambda s: ~valid_call(s["tool"], s["tool_input"])))
    ok = F.coalesce("ok", F.lit(False))
    done = turns.join(own.select("case_id", "scored"), "case_id").groupBy("case_id").agg(
        F.count("*").alias("attempted"), F.bool_and(ok).alias("all_ok"),
        F.sum(F.when(ok, F.size(actions)).otherwise(0)).alias("tool_calls"), F.sum(F.when(ok, invalid).otherwise(0)).alias("invalid_calls"),
        F.max_by(facts, F.when(F.col("turn") == F.col("scored"), 1)).alias("t"),
    )
    zero = F.lit(0).cast("long")
    full = own.join(done, "case_id", "left").withColumns({
        "errored": ~F.coalesce(F.col("all_ok") & (F.col("attempted") >= F.size("queries")), F.lit(False)),
        "tool_calls": F.coalesce("tool_calls", zero), "invalid_calls": F.coalesce("invalid_calls", zero),
    })
    # What an errored case lacks is null, and null goes through all that follows.
    full = full.withColumn("t", F.when(~F.col("errored"), F.col("t")))
    t, gold, chapter = F.col("t"), F.coalesce("gold", F.array().cast("array<int>")), F.col("chapter")
    answer = t["answer"]
    names = lambda n: F.regexp_like(answer, F.concat(F.lit(r"(?iu)điều\s*"), n.cast("string"), F.lit(r"(?![0-9])")))
    holds = lambda text, part: F.contains(plain(text), plain(part))
    cited = F.transform(t["cited"], lambda c: c["article"])
    label = F.concat(F.lit("chương "), F.lower(chapter["label"]))
    titled = lambda x: F.startswith(F.lower(x), label) & ~F.regexp_like(F.substring(F.lower(x), F.length(label) + 1, F.lit(1)), F.lit("[ivxlc]"))
    in_chapter = F.exists(t["cited"], lambda c: c["article"].between(chapter["first"], chapter["last"]) | F.coalesce(F.exists(c["breadcrumb"], titled), F.lit(False)))
    of_gold, of_chapter = t.isNotNull() & (F.size(gold) > 0), t.isNotNull() & (F.size(gold) == 0) & chapter.isNotNull()
    hits = F.size(F.filter(gold, lambda g: F.array_contains(cited, g)))
    full = full.withColumns({
        "citation_recall": F.when(of_gold, hits / F.size(gold)).when(of_chapter, in_chapter.cast("double")),
        "gold_hit": F.when(of_gold, hits > 0).when(of_chapter, in_chapter),
        "answer_cites_gold": F.when(of_gold, F.exists(gold, names)),
        "first_tool": t["first_tool"],
        "recall_called": t["recalled"],
    })
    hit, called = F.coalesce("gold_hit", F.lit(False)), F.col("recall_called")
    found = lambda part: F.coalesce(holds(t["recall"], part), F.lit(False))
    query = lambda i: F.get(F.col("queries"), i)
    # Only answers in fresh sessions are held against all queries.
    fresh = full.where((kind == "recall_fresh") & t.isNotNull()).select("case_id", answer.alias("answer"))
    quoted = quoted_queries(fresh, cases.select(F.explode("queries").alias("query"))).withColumn("quotes", F.lit(True))
    claims = F.lit(False)
    for phrase in L.PRIOR_QUESTIONS:
        claims = claims | holds(answer, F.lit(phrase))
    invented = ~(called & found(F.lit(L.FRESH_SESSION))) | F.regexp_like(answer, F.lit(r"(?iu)điều\s*[0-9]")) | F.coalesce("quotes", F.lit(False)) | claims
    shown = F.concat_ws("\n", F.coalesce(t["recall"], F.lit("")), answer, t["contents"])
    none = F.array().cast("array<string>")
    leak = F.exists(F.concat(F.array(query(F.lit(0))), F.coalesce("leaks", none)), lambda x: holds(shown, x))
    tool_types, step_types = ("explicit_article", "multi_hop", "global"), ("seed", "multi_hop", "explicit_article", "global")
    recall_ok = (
        F.when(kind == "recall_basic", called & found(query(F.lit(0))) & F.forall(F.coalesce("answer_names", F.array().cast("array<int>")), names))
        .when(kind == "recall_fresh", ~invented)
        .when(kind == "recall_far", called & found(query(F.coalesce("target_turn", F.lit(0)))))
        .when(kind == "followup_window", hit & ~called)
    )
    scored = lambda cond, x: F.when(t.isNotNull() & cond, x)
    return full.join(quoted, "case_id", "left").select(
        "case_id", "type", "errored", "citation_recall", "gold_hit", "answer_cites_gold", "first_tool", "tool_calls", "invalid_calls", "recall_called",
        scored(kind.isin(*tool_types) & F.col("expected_first_tool").isNotNull(), F.col("first_tool").eqNullSafe(F.col("expected_first_tool"))).alias("tool_choice_ok"),
        scored(kind.isin(*step_types), (t["calls"] >= max_steps) & ~hit).alias("budget_exhausted"),
        scored(F.lit(True), recall_ok).alias("recall_ok"),
        scored(kind == "recall_fresh", invented).alias("fabricated"),
        scored(kind == "isolation", leak).alias("isolation_leak"),
        scored(kind == "isolation", called).alias("isolation_exercised"),
    )


def dataset_violations(cases: DataFrame, corpus: DataFrame, declared: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """(rule, subject) of a case table: unknown gold articles, repeated ids,
    counts by type that differ from those declared, and gold chapters that aren't
    contiguous.

    Gold articles are the array ``gold`` of a case, or rows (case_id, article) of
    the table ``gold``, which needn't be gathered case by case.  They are dealt to
    tasks by their number.
    """
    gold = cases.select("case_id", F.explode("gold").alias("article")) if gold is None else gold.select("case_id", "article")
    rows = gold.count()
    known = corpus.select("article").where("article is not null").distinct()
    unknown = dealt(gold, rows, "article").join(known, "article", "left_anti").select(F.lit("unknown_article").alias("rule"), F.concat_ws(":", F.col("case_id").cast("string"), F.col("article").cast("string")).alias("subject"))
    repeated = cases.groupBy("case_id").count().where("count > 1").select(F.lit("repeated_id"), F.col("case_id").cast("string"))
    counts = cases.groupBy("type").agg(F.count("*").alias("n")).join(declared, "type", "full_outer").where("not (n <=> declared)").select(F.lit("count"), F.col("type").cast("string"))
    gaps = dealt(gold, rows, "case_id").groupBy("case_id").agg(F.min("article").alias("lo"), F.max("article").alias("hi"), F.countDistinct("article").alias("n")).where("hi - lo + 1 <> n").select(F.lit("not_contiguous"), F.col("case_id").cast("string"))
    return unknown.union(repeated).union(counts).union(gaps)


def mean_duration(metrics: DataFrame, operation: str) -> DataFrame:
    return metrics.where((F.col("operation") == operation) & F.col("success")).agg(F.coalesce(F.avg("duration"), F.lit(0.0)).alias("mean_ms"))


def cache_stats(events: DataFrame) -> DataFrame:
    hits, misses = F.sum(F.when(F.col("hit"), 1).otherwise(0)), F.sum(F.when(~F.col("hit"), 1).otherwise(0))
    return events.agg(hits.alias("hits"), misses.alias("misses"), F.coalesce(F.try_divide(hits.cast("double"), (hits + misses).cast("double")), F.lit(0.0)).alias("hit_rate"))


def latest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """What a ring buffer of ``n`` would hold."""
    return rows.orderBy(*order).limit(n)


def mean_rating(column: str) -> Column:
    """Mean of an aggregate's ratings, none counting as 0; 0 without rows."""
    return F.coalesce(F.sum(F.coalesce(F.col(column), F.lit(0))), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))
