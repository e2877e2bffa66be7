"""Failure categories of validation results that hold further ones: trees in one JSON column, taken apart level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let
from ..shared import materialise
from .validate import stage_category

TAXONOMY, MISSING, UNKNOWN = "failure_taxonomy", "missing_validation", "unknown_validation_failure"


def _object(json: Column) -> Column:
    """The members of a JSON object in their order, values as JSON text; null for anything else."""
    return F.when(F.ltrim(json).startswith("{"), F.from_json(json, "map<string, string>"))


def _true(json: Column) -> Column:
    return F.coalesce(~F.trim(json).isin("", "false", "null", "0", "0.0", "[]", "{}"), F.lit(False))


def _listed(json: Column) -> Column:
    """A JSON list's items; a single value is one item, null none."""
    items = F.when(F.ltrim(json).startswith("["), F.from_json(json, "array<string>")).when(json.isNotNull() & (json != "null"), F.array(json))
    return F.coalesce(items, F.array().cast("array<string>"))


def _text(members: Column, *names: str) -> Column:
    return F.array_join(F.concat(*[_listed(members[n]) for n in names]), "\n")


def _said(members: Column, stages: Column) -> Column:
    """What a result says of itself: state, the taxonomy that it has already, its stages while it is open, its text."""
    def said(existing: Column) -> Column:
        state = F.when(members.isNull(), "missing").when(existing["categories"].isNotNull(), "existing").when(_true(members["passed"]), "passed").otherwise("open")
        has = F.struct(_listed(existing["categories"]).alias("categories"), F.from_json(existing["category_counts"], "map<string, int>").alias("counts"), _listed(existing["failed_stages"]).alias("failed_stages"), existing["primary_category"].alias("primary_category"))
        return let(state, lambda k: F.struct(k.alias("state"), F.when(k == "existing", has).alias("existing"), F.when(k == "open", F.map_entries(stages)).alias("stages"), F.when(k == "open", _text(members, "logs", "counterexamples")).alias("text")))

    return let(_object(stages[TAXONOMY]), said)


def _result(json: Column) -> Column:
    return let(_object(json), lambda m: let(_object(m["stage_results"]), lambda stages: _said(m, stages)))


def _failed(stage: Column, at: Column) -> Column:
    """A failed stage: its categories, or the result that it holds; null for any other."""
    name = stage["key"]

    def told(m: Column) -> Column:
        category = F.filter(F.array(stage_category(name, _text(m, "logs", "warnings", "counterexamples"))), lambda c: c.isNotNull())
        both = let(_object(m["stage_results"]), lambda own: F.struct(at.alias("at"), name.alias("name"), F.when(own.isNull(), category).alias("categories"), F.when(own.isNotNull(), _said(m, own)).alias("result")))
        return F.when((name != TAXONOMY) & m.isNotNull() & ~_true(m["passed"]), both)

    return let(_object(stage["value"]), told)


def _nodes(found: DataFrame) -> DataFrame:
    """Results (node, parent, at, name, result) with parts, what their own stages say, and inner, their stages that hold results."""
    rows = found.withColumn("failed", F.filter(F.transform("result.stages", _failed), lambda x: x.isNotNull()))
    own = F.transform(F.filter("failed", lambda x: x["result"].isNull()), lambda x: F.struct(x["at"].alias("at"), x["categories"].alias("categories"), F.array(x["name"]).alias("failed")))
    return rows.select(*[c for c in found.columns if c != "result"], "result.state", "result.existing", "result.text", own.alias("parts"), F.filter("failed", lambda x: x["result"].isNotNull()).alias("inner"))


def _folded(nodes: DataFrame, below: DataFrame | None) -> DataFrame:
    """Each node with its taxonomy, from its own parts and those of the results below: (parent, at, categories, failed)."""
    rows = nodes.drop("inner")
    if below is not None:
        gathered = below.groupBy(F.col("parent").alias("of")).agg(F.collect_list(F.struct("at", "categories", "failed")).alias("theirs"))
        rows = rows.join(gathered, F.col("node") == F.col("of"), "left").withColumn("parts", F.when(F.col("theirs").isNull(), F.col("parts")).otherwise(F.array_sort(F.concat(F.coalesce("parts", F.array()), "theirs")))).drop("of", "theirs")
    none = F.array().cast("array<string>")
    failed = F.coalesce(F.flatten(F.transform("parts", lambda p: p["failed"])), none)
    named = F.coalesce(F.flatten(F.transform("parts", lambda p: p["categories"])), none)
    rows = rows.withColumns({"failed": failed, "named": named})
    told = stage_category(F.lit(""), F.col("text"))
    listed = F.when(F.size("named") > 0, F.col("named")).when(told.isNotNull(), F.array(told)).when(F.size("failed") > 0, F.array(F.lit(UNKNOWN))).otherwise(none)
    listed = F.when(F.col("state") == "missing", F.array(F.lit(MISSING))).when(F.col("state") == "open", listed).otherwise(none)
    rows = rows.withColumn("named", listed).withColumn("different", F.array_sort(F.array_distinct("named")))
    counts = F.map_from_entries(F.transform("different", lambda c: F.struct(c, F.size(F.filter("named", lambda x: x == c)))))
    own = F.struct(F.col("different").alias("categories"), counts.alias("counts"), F.col("failed").alias("failed_stages"), F.get("different", F.lit(0)).alias("primary_category"))
    return rows.withColumn("taxonomy", F.coalesce("existing", own))


def nested_taxonomy(validations: DataFrame, key: str = "work_id", validation: str = "validation") -> DataFrame:
    """(key, categories, counts, failed_stages, primary_category) of each different row of (key, validation), a validation result as JSON.

    A result has passed, logs, counterexamples and stage_results, an object
    of stages in order; a failed stage that has stage_results itself is
    classified likewise, its categories count once each, and its failed
    stages are named ``stage.inner``. Other failed stages go by name and
    text. If none has a category the result's own text speaks, and if that
    says nothing the failure is unknown. A taxonomy that a result holds
    already stands as it is. No result, or one that is no JSON object, is
    ``missing_validation``; one that has passed has no category.

    Trees of any depth: each level is one table, written before the next is
    taken from it, and the levels are folded from the deepest. A level's text
    is parsed once: what its stages say, and the results that they hold, are
    written with it. Rows of one tree meet by the node that they belong to,
    so a task holds one result's stages at most. An empty table stays empty.
    """
    rows = validations.select(F.col(key).alias("k"), F.col(validation).alias("v")).distinct()
    root = F.sha2(F.concat_ws("|", F.to_json(F.struct("k")), F.coalesce("v", F.lit(""))), 256)
    none = F.lit(None).cast("string")
    found = rows.select("k", root.alias("node"), none.alias("parent"), F.lit(None).cast("int").alias("at"), none.alias("name"), _result(F.col("v")).alias("result"))
    levels = []
    while True:
        levels.append(materialise(_nodes(found), "results"))
        inner = levels[-1].where(F.size("inner") > 0).select(F.col("node").alias("parent"), F.explode("inner").alias("s"))
        found = inner.select(F.concat_ws("/", "parent", F.col("s.at").cast("string")).alias("node"), "parent", "s.at", "s.name", "s.result")
        if inner.isEmpty():
            break
    below = None
    for nodes in reversed(levels):
        if below is not None:
            inside = F.transform("taxonomy.failed_stages", lambda s: F.concat_ws(".", F.col("name"), s))
            below = below.select("parent", "at", F.col("taxonomy.categories").alias("categories"), inside.alias("failed"))
        below = _folded(nodes, below)
    return below.select(F.col("k").alias(key), "taxonomy.*")
