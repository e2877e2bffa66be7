"""Code lines of functions, and what single lines say. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import any_of, let, lookup, squeezed
from .intervals import held

#: Columns that name a function; two functions of one name in two files, or at two places, are two.
FN = ["path", "fn", "ordinal"]
#: What counts as a name, a call and a cleanup call; results depend on them.
IDENT = "[A-Za-z_][A-Za-z_0-9]*"
CALL = r"\b([A-Za-z_][A-Za-z_0-9:]*)\s*\(([^()]*)\)"
CLEANUP = rf"\b({any_of(vocab.CLEANUP_CALLS)})\s*\(([^)]*)\)"


def uncommented(line: Column) -> Column:
    """A line without its comments, strings and characters as empty ones."""
    line = F.regexp_replace(line, "//.*$", "")
    line = F.regexp_replace(line, r"/\*.*?\*/", " ")
    line = F.regexp_replace(line, r'"(?:\\.|[^"\\])*+"', '""')
    return F.regexp_replace(line, r"'(?:\\.|[^'\\])*+'", "''")


def code_lines(functions: DataFrame) -> DataFrame:
    """(path, fn, ordinal, line, raw, stmt): the lines of each body that hold code, white space in stmt as single spaces.

    Line numbers count from the brace's line, so a signature over several
    lines shifts nothing. Blank lines and lone braces are left out.
    """
    lines = functions.select(*FN, "body_line", F.posexplode(F.split("body", "\n")).alias("at", "raw"))
    lines = lines.select(*FN, (F.col("body_line") + F.col("at")).alias("line"), "raw", squeezed(uncommented(F.col("raw"))).alias("stmt"))
    return lines.where(~F.col("stmt").isin("", "{", "}"))


def statements(functions: DataFrame) -> DataFrame:
    """As ``code_lines``, but only // comments are taken out: what data flow reads."""
    lines = functions.select(*FN, "body_line", F.posexplode(F.split("body", "\n")).alias("at", "raw"))
    lines = lines.select(*FN, (F.col("body_line") + F.col("at")).alias("line"), "raw", squeezed(F.regexp_replace("raw", "//.*$", "")).alias("stmt"))
    return lines.where(~F.col("stmt").isin("", "{", "}"))


def goto_target(stmt: Column) -> Column:
    found = F.regexp_extract(stmt, rf"\bgoto\s+({IDENT})\s*;", 1)
    return F.when(stmt.contains("goto") & (found != ""), found)


def label_name(stmt: Column) -> Column:
    found = F.regexp_extract(stmt, rf"^({IDENT})\s*:\s*(?!:)", 1)
    return F.when(stmt.contains(":") & ~found.isin("", "case", "default"), found)


def is_return(stmt: Column) -> Column:
    return stmt.rlike(r"^return\b")


def is_boundary(stmt: Column) -> Column:
    """Where control may leave or part: returns, gotos, branches, loops and cases."""
    return is_return(stmt) | stmt.rlike(r"^(goto |if ?\(|if |else|switch ?\(|switch |case |default:|for ?\(|for |while ?\(|while )")


def statement_class(stmt: Column) -> Column:
    return (
        F.when(is_return(stmt), "return")
        .when(goto_target(stmt).isNotNull(), "goto")
        .when(stmt.rlike(r"^(if|else\s+if|else)\b"), "branch")
        .when(stmt.rlike(r"^(for|while|do)\b"), "loop")
        .when(stmt.rlike(r"^switch\b"), "switch")
        .when(label_name(stmt).isNotNull(), "label")
        .otherwise("other")
    )


def is_error_return(stmt: Column) -> Column:
    return F.lower(stmt).rlike(r"^return\b.*(-1|null|false|err)")


def cleanup_call(stmt: Column) -> Column:
    """(call, variable) of the first cleanup call, null without one."""
    call = F.regexp_extract(stmt, CLEANUP, 1)
    return F.when(stmt.contains("(") & (call != ""), F.struct(call.alias("call"), F.regexp_extract(F.regexp_extract(stmt, CLEANUP, 2), IDENT, 0).alias("variable")))


def if_condition(stmt: Column) -> Column:
    """What stands between if's bracket and the line's last one."""
    return F.when(stmt.contains("if") & stmt.rlike(r"\bif\s*\(.*\)"), F.trim(F.regexp_extract(stmt, r"\bif\s*\((.*)\)", 1)))


def calls_with_arguments(stmt: Column) -> Column:
    """(call, args) of the innermost calls, in order; of qualified names the last part."""
    found = F.arrays_zip(F.regexp_extract_all(stmt, F.lit(CALL), F.lit(1)).alias("call"), F.regexp_extract_all(stmt, F.lit(CALL), F.lit(2)).alias("args"))
    return F.transform(found, lambda x: F.struct(F.element_at(F.split(x["call"], "::"), -1).alias("call"), x["args"].alias("args")))


def resource_expression(text: Column) -> Column:
    """The variable that an expression names: its last identifier, or its last chain of fields and indices. Empty if none."""
    chain = rf"{IDENT}(?:\s*(?:->|\.)\s*{IDENT}|\s*\[[^\]]+\])*"

    def last(t: Column, pattern: str) -> Column:
        return F.coalesce(F.try_element_at(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.lit(-1)), F.lit(""))

    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), ";+$", ""), r"^\([^)]*\)\s*", ""), "^[&*]+", ""))
    return let(bare, lambda t: F.when(t.rlike(r"->|\.|\["), F.regexp_replace(last(t, chain), r"\s+", "")).otherwise(last(t, IDENT)))


def first_argument(args: Column) -> Column:
    first = F.try_element_at(F.filter(F.split(args, ","), lambda x: F.trim(x) != ""), F.lit(1))
    return resource_expression(F.coalesce(first, F.lit("")))


ASSIGNED = rf"([A-Za-z_][A-Za-z_0-9:<>*\s&.\->\[\]]*?)\s*=\s*(?:\([^)]*\)\s*)?({IDENT})\s*\("


def assignment_call(stmt: Column) -> Column:
    """(variable, call) of an assignment from a call, casts allowed; null where there is none."""
    variable = resource_expression(F.regexp_extract(stmt, ASSIGNED, 1))
    return F.when(stmt.contains("=") & stmt.rlike(ASSIGNED) & (variable != ""), F.struct(variable.alias("variable"), F.regexp_extract(stmt, ASSIGNED, 2).alias("call")))


#: What single lines say, by name: columns that ``noted`` adds to lines.
NOTES = {"says_return": is_return, "says_goto": goto_target, "says_label": label_name, "says_cleanup": cleanup_call, "says_condition": if_condition, "says_calls": calls_with_arguments, "says_assigned": assignment_call}


def noted(lines: DataFrame) -> DataFrame:
    """``lines`` with all NOTES, for tables that are written once and read in many branches."""
    return lines.withColumns({name: of(F.col("stmt")) for name, of in NOTES.items()})


def note(lines: DataFrame, name: str) -> Column:
    """One of NOTES: as it is noted in ``lines``, else read off stmt."""
    return F.col(name) if name in lines.columns else NOTES[name](F.col("stmt"))


def resource_events(lines: DataFrame) -> DataFrame:
    """(path, fn, ordinal, line, kind, variable, call, raw): acquisitions and releases, one for each kind, variable and place.

    An assigned call acquires what it is assigned to. Other calls release
    (or lock) their first argument; they acquire it if the line assigns no
    call.
    """
    read = lines.withColumns({"assigned": note(lines, "says_assigned"), "calls": note(lines, "says_calls")})
    acquired = read.where("assigned IS NOT NULL").select(*FN, "line", "raw", F.lit(True).alias("is_assigned"), F.col("assigned.call").alias("call"), F.col("assigned.variable").alias("variable"))
    called = read.select(*FN, "line", "raw", "assigned", F.explode("calls").alias("c")).where("assigned IS NULL OR c.call <> assigned.call")
    called = called.select(*FN, "line", "raw", F.lit(False).alias("is_assigned"), F.col("c.call").alias("call"), first_argument(F.col("c.args")).alias("variable"), F.col("assigned").isNotNull().alias("other"))
    both = acquired.withColumn("other", F.lit(False)).unionByName(called).withColumn("kind", lookup(F.col("call"), vocab.EVENT_CALLS))
    opens = F.col("kind").isin("alloc", "open")
    valid = F.when(F.col("is_assigned"), F.col("kind").isin(*vocab.RELEASE_OF)).otherwise(~(opens & F.col("other")))
    return both.where("kind IS NOT NULL").where(valid).select(*FN, "line", "kind", "variable", "call", "raw").dropDuplicates([*FN, "line", "kind", "variable", "call"])


def flow_events(stmts: DataFrame) -> DataFrame:
    """The same by data flow's own words: assignments without casts, and calls."""
    plain = rf"\b({IDENT})\s*=\s*({IDENT})\s*\("
    acquired = stmts.where(F.col("stmt").rlike(plain)).select(*FN, "line", F.regexp_extract("stmt", plain, 1).alias("variable"), lookup(F.regexp_extract("stmt", plain, 2), vocab.FLOW_ASSIGNED).alias("kind"))
    pattern = rf"\b({IDENT})\s*\(([^)]*)\)"
    zipped = F.arrays_zip(F.regexp_extract_all("stmt", F.lit(pattern), F.lit(1)).alias("call"), F.regexp_extract_all("stmt", F.lit(pattern), F.lit(2)).alias("args"))
    called = stmts.select(*FN, "line", F.explode(zipped).alias("c"))
    argument = F.regexp_replace(F.trim(F.split("c.args", ",")[0]), "^[&*]+", "")
    called = called.select(*FN, "line", argument.alias("variable"), lookup(F.col("c.call"), vocab.FLOW_CALLED).alias("kind"))
    return acquired.unionByName(called).where("kind IS NOT NULL")


def labelled(lines: DataFrame) -> DataFrame:
    """Lines inside label blocks, with label: a label's own line, if code follows there, and all lines up to the next label."""
    own = note(lines, "says_label")
    order = Window.partitionBy(*FN).orderBy("line")
    marked = lines.withColumn("own", own).withColumn("label", F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rest = F.trim(F.regexp_replace("stmt", r"^[^:]*:", ""))
    marked = marked.withColumn("stmt", F.when(F.col("own").isNotNull(), rest).otherwise(F.col("stmt")))
    return marked.where("label IS NOT NULL AND stmt <> '' AND stmt <> '}'").drop("own")


def nearby(lines: DataFrame, points: DataFrame, radius: int) -> DataFrame:
    """``points`` (with path, fn, ordinal, line) and snippet: the code within ``radius`` lines, numbered."""
    around = points.select(*FN, F.col("line").alias("at"), (F.col("line") - radius).alias("from"), (F.col("line") + radius).alias("to")).distinct()
    close = held(lines, around, FN, "line", "from", "to", also=["stmt"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "stmt"))), lambda x: F.concat(x["line"].cast("string"), F.lit(": "), x["stmt"])), "\n")
    return points.join(close.groupBy(*FN, F.col("at").alias("line")).agg(text.alias("snippet")), [*FN, "line"], "left")
