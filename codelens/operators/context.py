"""What a function's facts say of its surroundings: error paths, returns, side effects, resources, ownership; indexes over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import any_of, listed
from .facts import body_facts, pointer_variables, status_variables
from .graph import blocks, data_edges
from .lines import FN

RELEASE_KINDS = ["free", "close", "unlock"]


def _in_order(events: DataFrame, what: Column, name: str, only: list[str] | None = None) -> DataFrame:
    """(FN, name): an entry for each event, by line."""
    rows = events.where(F.col("kind").isin(only)) if only else events
    entry = F.struct("line", "kind", "call", what.alias("t"))
    return rows.groupBy(*FN).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]).alias(name))


def error_paths(functions: DataFrame, events: DataFrame) -> DataFrame:
    """(FN, paths): gotos and labels named for errors, returns of failure values, and releases with their lines, in this order."""
    named = lambda x: F.lower(x).rlike(any_of(vocab.PATH_TOKENS))
    failing = lambda x: F.lower(x).rlike(any_of(vocab.FAILURE_TOKENS))
    released = _in_order(events, F.concat("kind", F.lit(" "), "variable", F.lit(" at line "), F.col("line").cast("string")), "released", RELEASE_KINDS)
    facts = body_facts(functions).join(released, FN, "left")
    labels = F.transform(F.filter("labels", named), lambda x: F.concat(F.lit("label "), x))
    return facts.select(*FN, F.concat(F.filter("gotos", named), labels, F.filter("returns", failing), F.coalesce("released", F.array().cast("array<string>"))).alias("paths"))


def return_summaries(functions: DataFrame) -> DataFrame:
    """(FN, returns): the forms of a function's returns, listed."""
    return body_facts(functions).select(*FN, F.when(F.size("returns") == 0, "No explicit return statements.").otherwise(listed(F.col("returns"))).alias("returns"))


def side_effects(functions: DataFrame, events: DataFrame) -> DataFrame:
    """(FN, effects): calls and resource events, listed."""
    used = _in_order(events, F.concat("kind", F.lit("("), "variable", F.lit(")")), "used")
    facts = body_facts(functions).join(used, FN, "left")
    pieces = F.array(F.when(F.size("calls") > 0, F.concat(F.lit("calls "), listed(F.col("calls")))), F.when(F.size("used") > 0, F.concat(F.lit("resource events "), listed(F.col("used")))))
    text = F.array_join(F.filter(pieces, lambda x: x.isNotNull()), "; ")
    return facts.select(*FN, F.when(text == "", "No obvious calls or resource events.").otherwise(text).alias("effects"))


def function_facts(functions: DataFrame, events: DataFrame) -> DataFrame:
    """(FN, pointers, status, resources): sorted names of pointers, of defined status variables, and of pointers and event variables together."""
    sets = [
        pointer_variables(functions).select(*FN, "variable", F.lit("pointer").alias("role")), status_variables(functions).select(*FN, "variable", F.lit("status").alias("role")),
        events.where("variable <> ''").select(*FN, "variable", F.lit("event").alias("role")),
    ]
    rows = sets[0].unionByName(sets[1]).unionByName(sets[2])
    of = lambda *roles: F.array_sort(F.collect_set(F.when(F.col("role").isin(*roles), F.col("variable"))))
    got = rows.groupBy(*FN).agg(of("pointer").alias("pointers"), of("status").alias("status"), of("pointer", "event").alias("resources"))
    none = F.array().cast("array<string>")
    return functions.select(*FN).join(got, FN, "left").select(*FN, *[F.coalesce(c, none).alias(c) for c in ("pointers", "status", "resources")])


def full_summaries(functions: DataFrame, events: DataFrame) -> DataFrame:
    """(FN, summary): a function's place, blocks, calls, gotos, resources, status variables, returns, side effects and error paths in one text."""
    n_blocks = blocks(functions).groupBy(*FN).agg(F.count(F.lit(1)).alias("n_blocks"))
    facts = body_facts(functions).select(*FN, "start_line", "end_line", "calls", F.size("gotos").alias("n_gotos"))
    for more in (n_blocks, function_facts(functions, events), return_summaries(functions), side_effects(functions, events), error_paths(functions, events)):
        facts = facts.join(more, FN, "left")
    at = F.concat("fn", F.lit(" in "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    counts = F.concat(F.lit("blocks "), F.coalesce("n_blocks", F.lit(0)).cast("string"), F.lit(", gotos "), F.col("n_gotos").cast("string"))
    lists = [F.concat(F.lit(f"{name}: "), listed(F.col(c))) for name, c in (("calls", "calls"), ("resources", "resources"), ("status", "status"))]
    return facts.select(*FN, F.concat_ws("; ", at, counts, *lists, F.concat(F.lit("returns: "), "returns"), F.concat(F.lit("side effects: "), "effects"), F.concat(F.lit("error paths: "), listed(F.col("paths")))).alias("summary"))


def resource_nodes(events: DataFrame) -> DataFrame:
    """(FN, node, kind, variable, line) of each resource event; one without a variable goes by its kind."""
    name = F.when(F.col("variable") != "", F.col("variable")).otherwise(F.col("kind"))
    return events.select(*FN, F.concat(F.lit("resource:"), "fn", F.lit(":"), name, F.lit(":"), F.col("line").cast("string")).alias("node"), "kind", "variable", "line").distinct()


def resource_edges(functions: DataFrame, events: DataFrame) -> DataFrame:
    """(FN, src, dst, edge): from the function's first block, where facts without a block meet, to each resource node."""
    first = blocks(functions).where("k = 1").select(*FN, F.col("block").alias("src"))
    return resource_nodes(events).select(*FN, F.col("node").alias("dst")).distinct().join(first, FN).select(*FN, "src", "dst", F.lit("resource").alias("edge"))


def all_edges(control: DataFrame, calls: DataFrame, functions: DataFrame, events: DataFrame) -> DataFrame:
    """(path, src, dst, edge) of all kinds, each once."""
    rows = control.select("path", "src", "dst", "edge").unionByName(calls.select("path", "src", "dst", F.lit("call").alias("edge")))
    rows = rows.unionByName(data_edges(functions).select("path", "src", "dst", F.lit("data").alias("edge")))
    return rows.unionByName(resource_edges(functions, events).select("path", "src", "dst", "edge")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, callees): what each function calls, each once and sorted."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("callees"))


def index_counts(functions: DataFrame, block_rows: DataFrame, edges: DataFrame, backend: Column | str = "unknown") -> DataFrame:
    """(what, n): functions of each parser, and all functions, blocks and edges."""
    by = backend if isinstance(backend, Column) else F.lit(backend)
    rows = functions.groupBy(F.concat(F.lit("functions by "), F.coalesce(by, F.lit("unknown"))).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    for name, table in (("functions", functions), ("blocks", block_rows), ("edges", edges)):
        rows = rows.unionByName(table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n"))
    return rows


def ownership_evidence(functions: DataFrame) -> DataFrame:
    """(FN, releases, transfers, borrows, evidence): what name and body suggest of a function's arguments, and by which hints."""
    name = F.lower("fn")
    hints = {
        "releases": name.rlike(any_of(vocab.RELEASE_HINTS)), "transfers": name.rlike(any_of(vocab.TRANSFER_HINTS)), "borrows": name.rlike(any_of(vocab.BORROW_HINTS)),
        "body": F.col("body").rlike(vocab.RELEASE_PRIMITIVE),
    }
    said = F.filter(F.array(*[F.when(hints[k], F.lit(text)) for k, text in vocab.OWNERSHIP_EVIDENCE.items()]), lambda x: x.isNotNull())
    return functions.select(*FN, (hints["releases"] | hints["body"]).alias("releases"), hints["transfers"].alias("transfers"), hints["borrows"].alias("borrows"), said.alias("evidence"))
