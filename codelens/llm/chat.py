"""Preference formatting: one prompt, two completions, and the spans that carry loss.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<turn:bigint,role:string,text:string>>"
#: What stands before and after a turn's text.
HEAD, ROLE_END, TAIL = "<|", "|>\n", "<|end|>\n"


def _collected(turns: DataFrame, key: str, name: str) -> DataFrame:
    """A row for each conversation: its different turns in order of number, role and text."""
    one = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where(F.col(key).isNotNull() & F.col("turn").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(one)).alias(name))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(ROLE_END))


def render(turns: Column) -> Column:
    """The turns as text, each with its role before it and an end mark after it."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(TAIL))), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """(start, end) in the rendered turns, in code points, of what ``role`` says, each time with the end mark: the rest is masked."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(_head(t))
        stop = start + F.length(t["text"]) + len(TAIL)
        span = F.array(F.struct(start.alias("start"), (stop - 1).alias("end")))
        return F.struct(stop.alias("at"), F.when(t["role"] == role, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, begin, step, lambda s: s["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id", role: str = "assistant") -> DataFrame:
    """(key, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans) for each key that both tables hold.

    Both hold (key, turn, role, text), a row for each turn. The turns on
    which the two conversations agree from the start, in role and text, are
    the prompt, rendered once; what follows on either side is rendered as its
    completion, and the spans say which part of that carries loss.

    Repeated rows count once; turns with the same number are ordered by role
    and text. Null roles and texts are empty; rows with a null key or turn
    belong to no conversation. Equal conversations have two empty
    completions. Other columns are left out. A conversation becomes a row,
    as it must in the result; no larger group is ever gathered.
    """
    return format_pairs(_collected(chosen, key, "chosen_turns").join(_collected(rejected, key, "rejected_turns"), key), key, role)


def format_pairs(pairs: DataFrame, key: str = "conv_id", role: str = "assistant") -> DataFrame:
    """As ``format_preferences``, of pairs (key, chosen_turns, rejected_turns) that lie side by side as arrays of TURNS in order. Nothing is shuffled."""
    c, r = F.col("chosen_turns"), F.col("rejected_turns")
    both = F.least(F.size(c), F.size(r))
    same = F.zip_with(F.slice(c, F.lit(1), both), F.slice(r, F.lit(1), both), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    pairs = pairs.select(F.col(key).alias("id"), c, r, same.alias("same"))
    pairs = pairs.withColumn("n_common", F.when(F.array_contains("same", False), F.array_position("same", F.lit(False)) - 1).otherwise(F.size("same").cast("long")).cast("int"))
    pairs = pairs.select("id", "n_common", F.slice(c, F.lit(1), F.col("n_common")).alias("p"), *[F.slice(x, F.col("n_common") + 1, F.size(x)).alias(name) for name, x in (("c", c), ("r", r))])
    return pairs.select(F.col("id").alias(key), "n_common", render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"), loss_spans(F.col("c"), role).alias("chosen_spans"), loss_spans(F.col("r"), role).alias("rejected_spans"))


def stale_pairs(turns: DataFrame, key: str = "conv_id", role: str = "assistant") -> DataFrame:
    """(key, chosen_turns, rejected_turns) out of plain conversations: each up to its last reply, and the same with the reply before in the last one's place.

    A reply that answers an earlier turn is a rejected answer to this one;
    where there is no earlier one, the rejected reply is empty. Conversations
    without a reply give no pair. Turns are gathered once, and all else are
    functions of the arrays.
    """
    whole = _collected(turns, key, "turns")
    replies = F.filter("turns", lambda t: t["role"] == role)
    whole = whole.withColumns({"replies": replies, "last": F.array_max(F.transform(replies, lambda t: t["turn"]))}).where("last IS NOT NULL")
    stale = F.array_max(F.transform(F.filter("replies", lambda t: t["turn"] < F.col("last")), lambda t: F.struct(t["turn"].alias("turn"), t["text"].alias("text"))))["text"]
    whole = whole.select(key, "last", F.filter("turns", lambda t: t["turn"] <= F.col("last")).alias("chosen_turns"), F.coalesce(stale, F.lit("")).alias("stale"))
    text = lambda t: F.when((t["turn"] == F.col("last")) & (t["role"] == role), F.col("stale")).otherwise(t["text"])
    other = F.transform("chosen_turns", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), text(t).alias("text")))
    return whole.select(key, "chosen_turns", F.array_sort(F.array_distinct(other)).alias("rejected_turns"))


def written(spans: Column) -> Column:
    """Spans as start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
