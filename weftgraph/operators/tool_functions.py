"""Tools as table functions for SQL: over a table of calls, or laterally over texts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

CALL = ("run_id", "seq", "tool", "args")


class JudgedCalls:
    """``judge_calls(TABLE(calls), budget => 3, required => '{"tool": ["field"]}')``:
    the calls with ``refusal``, as ``tools.judged_calls`` gives it.

    ``calls`` has run_id, seq, tool, args (JSON); other columns are kept.  The
    analysis asks for each run's calls together and in order, so a call of the
    function names neither; budget and required must be constants.
    """

    @staticmethod
    def analyze(calls: AnalyzeArgument, budget: AnalyzeArgument, required: AnalyzeArgument) -> AnalyzeResult:
        if not calls.isTable or (missing := set(CALL) - set(calls.dataType.names)):
            raise ValueError(f"judge_calls takes a table with {', '.join(CALL)}" + (f"; it lacks {', '.join(sorted(missing))}" if calls.isTable else ""))
        if not budget.isConstantExpression or not required.isConstantExpression:
            raise ValueError("budget and required must be constants")
        schema = StructType([*calls.dataType.fields]).add("refusal", StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("run_id")], orderBy=[OrderingColumn("seq")])

    def __init__(self) -> None:
        self.place = 0

    def eval(self, calls: Row, budget: int, required: str) -> Iterator[tuple]:
        self.place += 1
        yield (*calls, self._refusal(calls["tool"], calls["args"], budget, json.loads(required)))

    def _refusal(self, tool: str | None, args: str | None, budget: int, required: dict[str, list[str]]) -> str | None:
        if self.place > budget:
            return "over budget"
        if tool not in required:
            return "unknown tool"
        try:
            given = json.loads(args)
        except (TypeError, ValueError):
            given = None
        filled = isinstance(given, dict) and all(given.get(f) not in (None, "") for f in required[tool])
        return None if filled else "invalid arguments"

    def terminate(self) -> Iterator[tuple]:
        yield from ()


class CitedArticles:
    """``cited_articles(text)``: (place, article, clauses) of the articles that a text
    names ("Điều 5"), each once in the order of first mention, with the clauses
    ("khoản 2") that stand before it since the article in front."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        if text.isTable or not isinstance(text.dataType, StringType):
            raise ValueError("cited_articles takes a text")
        return AnalyzeResult(StructType().add("place", IntegerType()).add("article", LongType()).add("clauses", ArrayType(LongType())))

    def eval(self, text: str | None) -> Iterator[tuple]:
        found: dict[int, list[int]] = {}
        clauses: list[int] = []
        for word, number in re.findall(r"(?i)(điều|khoản)\s+([0-9]{1,18})", text or ""):
            if word.lower() == "khoản":
                clauses.append(int(number))
            else:
                own = found.setdefault(int(number), [])
                own += [c for c in dict.fromkeys(clauses) if c not in own]
                clauses = []
        for place, (article, own) in enumerate(found.items()):
            yield place, article, own


def register(spark: SparkSession) -> None:
    """Makes the tools known to the session's SQL."""
    spark.udtf.register("judge_calls", udtf(JudgedCalls))
    spark.udtf.register("cited_articles", udtf(CitedArticles))
