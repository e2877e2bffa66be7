"""Control flow, calls, data flow and summaries as edge and node tables. Every traversal is one hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import any_of, listed
from .facts import body_facts, definitions, uses
from .lines import FN, goto_target, is_return, label_name, statements


def blocks(functions: DataFrame) -> DataFrame:
    """(FN, k, block, stmt): a block for each statement, from 1, in order.

    A line is cut after each semicolon outside brackets; the heads of control
    structures and labels end where their line does. Braces around a
    statement are left out.
    """
    lines = statements(functions).withColumn("stmt", F.regexp_replace("stmt", r"/\*.*?\*/", " "))
    cut = F.filter(F.transform(F.regexp_extract_all("stmt", F.lit(r"(?:[^;()]|\((?:[^()]|\([^()]*\))*\))+;?"), F.lit(0)), lambda x: F.regexp_replace(x, r"^[{}\s]+|[{}\s]+$", "")), lambda x: ~x.isin("", ";"))
    parts = lines.select(*FN, "line", F.posexplode(cut).alias("at", "stmt"))
    order = Window.partitionBy(*FN).orderBy("line", "at")
    out = parts.withColumn("k", F.row_number().over(order))
    return out.select(*FN, "k", F.concat("fn", F.lit(":bb"), F.col("k").cast("string")).alias("block"), "stmt", "line")


def control_edges(functions: DataFrame) -> DataFrame:
    """(FN, src, dst, edge): entry, next, skipped, back, goto and return edges between blocks."""
    stmt = F.col("stmt")
    order = Window.partitionBy(*FN).orderBy("k")
    b = blocks(functions).withColumns({"next": F.lead("block", 1).over(order), "after": F.lead("block", 2).over(order), "target": goto_target(stmt)})
    leave = F.concat("fn", F.lit(":exit"))
    falls = F.col("target").isNull() & ~is_return(stmt)
    edge = lambda src, dst, kind: F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge"))
    here = F.col("block")
    skips = stmt.rlike(r"^(if|else\s+if|else|switch)\b")
    made = F.array(
        F.when(F.col("k") == 1, edge(F.concat("fn", F.lit(":entry")), here, "control")),
        F.when(is_return(stmt) & F.col("target").isNull(), edge(here, leave, "return")),
        F.when(falls, edge(here, F.coalesce("next", leave), "control")),
        F.when(falls & skips & F.col("next").isNotNull(), edge(here, F.coalesce("after", leave), "control")),
        F.when(falls & stmt.rlike(r"^(for|while|do)\b") & F.col("next").isNotNull(), edge(F.col("next"), here, "control")),
    )
    flow = b.select(*FN, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("e")).select(*FN, "e.*")
    labels = b.withColumn("target", label_name(stmt)).where("target IS NOT NULL").groupBy(*FN, "target").agg(F.max_by("block", "k").alias("dst"))
    jumps = b.where("target IS NOT NULL").select(*FN, "target", F.col("block").alias("src")).join(labels, [*FN, "target"]).select(*FN, "src", "dst", F.lit("goto").alias("edge"))
    empty = functions.select(*FN).join(b.select(*FN).distinct(), FN, "left_anti").select(*FN, F.concat("fn", F.lit(":entry")).alias("src"), leave.alias("dst"), F.lit("control").alias("edge"))
    return flow.unionByName(jumps).unionByName(empty).dropDuplicates([*FN, "src", "dst", "edge"])


def resolved_calls(calls: DataFrame, names: DataFrame) -> DataFrame:
    """``calls`` (call) with dst: a known name, else the least known one with the same last part, else the call itself."""
    last = lambda c: F.element_at(F.split(c, "::"), -1)
    exact = names.select(F.col("name").alias("call"), F.col("name").alias("exact")).distinct()
    short = names.groupBy(last(F.col("name")).alias("short")).agg(F.min("name").alias("by_short"))
    return calls.withColumn("short", last(F.col("call"))).join(exact, "call", "left").join(short, "short", "left").withColumn("dst", F.coalesce("exact", "by_short", "call")).drop("exact", "by_short", "short")


def call_edges(functions: DataFrame) -> DataFrame:
    """(path, src, dst): different calls of each function, resolved against all function names."""
    calls = body_facts(functions).select("path", F.col("fn").alias("src"), F.explode("calls").alias("call"))
    return resolved_calls(calls, functions.select(F.col("fn").alias("name"))).select("path", "src", "dst").distinct()


def callers_and_callees(edges: DataFrame, name: str) -> DataFrame:
    """(role, other) of one function."""
    callers = edges.where(F.col("dst") == name).select(F.lit("caller").alias("role"), F.col("src").alias("other"))
    return callers.union(edges.where(F.col("src") == name).select(F.lit("callee"), F.col("dst"))).distinct()


def data_edges(functions: DataFrame) -> DataFrame:
    """(FN, src, dst): from the first block to each variable defined, and from each of these that is used back to it.

    Facts carry no block of their own, so all meet at the function's first.
    """
    first = blocks(functions).where("k = 1").select(*FN, "block")
    variable = F.concat(F.lit("var:"), F.col("fn"), F.lit(":"), F.col("variable"))
    defined = definitions(functions).select(*FN, "variable").distinct()
    used = uses(functions).select(*FN, "variable").distinct().join(defined, [*FN, "variable"], "left_semi")
    out = defined.join(first, FN).select(*FN, F.col("block").alias("src"), variable.alias("dst"))
    return out.unionByName(used.join(first, FN).select(*FN, variable.alias("src"), F.col("block").alias("dst")))


def summaries(functions: DataFrame, events: DataFrame) -> DataFrame:
    """(FN, calls, gotos, resources, error_paths, summary): a function's context in a sentence, aggregated once for all its findings."""
    facts = body_facts(functions)
    resources = events.groupBy(*FN).agg(F.array_sort(F.collect_set("variable")).alias("resources"))
    errors = F.filter(F.concat(F.col("labels"), F.col("gotos")), lambda x: F.lower(x).rlike(any_of(vocab.ERROR_LABELS)))
    out = facts.join(resources, FN, "left").select(
        *FN, "start_line", "end_line", listed(F.col("calls")).alias("calls"), F.size("gotos").alias("gotos"), listed(F.col("resources")).alias("resources"), listed(errors).alias("error_paths")
    )
    text = F.concat("fn", F.lit(" spans "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("; calls="), "calls", F.lit(", gotos="), F.col("gotos").cast("string"), F.lit(", resources="), "resources", F.lit(", error_paths="), "error_paths")
    return out.withColumn("summary", text).drop("start_line", "end_line")
