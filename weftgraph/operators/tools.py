"""Tool calls as rows: which are run, and why others are refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def judged_calls(calls: DataFrame, required: dict[str, tuple[str, ...]], budget: int) -> DataFrame:
    """``refusal`` of each call: null for one that is run.

    ``calls``: run_id, seq, tool, args (JSON).  Unknown tools and arguments that
    are no object or lack a required field are refused; so is whatever comes
    after ``budget`` calls of a run, counted over all of them.
    """
    args = F.try_parse_json("args")
    whole = F.startswith(F.schema_of_variant(args), F.lit("OBJECT"))

    def complete(fields: tuple[str, ...]) -> Column:
        ok = F.coalesce(whole, F.lit(False))
        for f in fields:
            ok = ok & F.coalesce(F.try_variant_get(args, f"$.{f}", "string") != "", F.lit(False))
        return ok

    valid = F.lit(False)
    for tool, fields in required.items():
        valid = valid | ((F.col("tool") == tool) & complete(fields))
    place = F.row_number().over(W.partitionBy("run_id").orderBy("seq"))
    refusal = F.when(place > budget, "over budget").when(~F.col("tool").isin(*required), "unknown tool").when(~valid, "invalid arguments")
    return calls.withColumn("refusal", refusal)
