"""Repair in rounds: candidates for what is still open, validated, their failures told to the next round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.review import folded_candidates
from ..shared import discard, materialise

#: What an opportunity hears for which a round has no candidate.
NONE_MADE = "no candidate was made"


def repair_rounds(opportunities: DataFrame, generate: Callable[[DataFrame, int], DataFrame], validate: Callable[[DataFrame], DataFrame], rounds: int = 3, key: str = "opportunity_id") -> DataFrame:
    """(key, round, candidate, tried, messages) of each different opportunity: its first candidate that passes, or what its last round failed with.

    In each round, from 0, ``generate(open, round)`` gets the opportunities
    without a patch, with the ``messages`` of the round before (none in the
    first), and returns candidates (key, candidate and whatever they consist
    of); ``validate`` adds passed and logs. Of a round's candidates the first
    by number that passes is taken, and ``tried`` counts all up to it; later
    ones of its round don't count. One without a verdict has failed. The
    failures of all its candidates, or ``NONE_MADE``, are an opportunity's
    messages. round and candidate are null for those that stay open.

    Each round's verdicts are written before the next begins, and only open
    opportunities go on; with none left the rounds end. An empty table stays
    empty, null keys have no candidates.
    """
    kind = opportunities.schema[key].dataType
    open_ = materialise(opportunities.select(key).distinct().withColumns({"messages": F.array().cast("array<string>"), "before": F.lit(0).cast("long")}), "open")
    none = {"round": F.lit(None).cast("int"), "candidate": F.lit(None).cast("int")}
    out = None
    for n in range(max(1, rounds)):
        made = generate(open_.select(key, "messages"), n)
        verdicts = materialise(validate(made).select(F.col(key).cast(kind), F.col("candidate").cast("int"), F.coalesce("passed", F.lit(False)).alias("passed"), "logs"), "verdicts")
        first = verdicts.groupBy(key).agg(F.min(F.when(F.col("passed"), F.col("candidate"))).alias("chosen"))
        counted = verdicts.join(first, key).groupBy(key, "chosen").agg(F.count_if(F.col("chosen").isNull() | (F.col("candidate") <= F.col("chosen"))).alias("here"))
        told = folded_candidates(verdicts, key).select(key, F.col("messages").alias("told"))
        state = open_.drop("messages").join(counted, key, "left").join(told, key, "left")
        state = materialise(state.select(key, "chosen", (F.col("before") + F.coalesce("here", F.lit(0))).alias("tried"), F.coalesce("told", F.array(F.lit(NONE_MADE))).alias("messages")), "state")
        solved = state.where("chosen IS NOT NULL").select(key, F.lit(n).alias("round"), F.col("chosen").alias("candidate"), "tried", F.array().cast("array<string>").alias("messages"))
        out = solved if out is None else out.unionByName(solved)
        discard(verdicts)
        open_ = state.where("chosen IS NULL").select(key, "messages", F.col("tried").alias("before"))
        if open_.isEmpty():
            break
    return out.unionByName(open_.withColumns(none).select(key, "round", "candidate", F.col("before").alias("tried"), "messages"))
