"""Facts of function bodies, read off the masked text. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import any_of, squeezed
from .lines import FN, IDENT, statements

#: Calls with namespaces, what stands before declared names (types and qualifiers), and assignments; results depend on them.
QUALIFIED = rf"\b({IDENT}(?:::{IDENT})*)\s*\("
DECLARED = rf"^(?:(?:const|static|volatile|unsigned|signed|long|short)\s+|(?:struct|enum|union)\s+{IDENT}\s+|[A-Za-z_][A-Za-z_0-9:<>]*\s+)+"
ASSIGNING = rf"\b({IDENT})\s*(?:=|\+=|-=|\*=|/=|%=|\+\+|--)"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _known(names: list[str]) -> str:
    return "^(" + any_of(names) + ")$"


def body_facts(functions: DataFrame) -> DataFrame:
    """``functions`` with returns, gotos, labels and calls: different ones in order of first appearance."""
    clear = F.col("masked")
    last = lambda c: F.element_at(F.split(c, "::"), -1)
    facts = {
        "returns": F.transform(_all(clear, r"\breturn\b[^;]*;"), squeezed),
        "gotos": F.transform(_all(clear, rf"\bgoto\s+{IDENT}\s*;"), squeezed),
        "labels": F.filter(_all(clear, rf"(?m)^\s*({IDENT})\s*:\s*(?!:)", 1), lambda x: ~x.rlike(_known(vocab.NOT_LABELS))),
        "calls": F.filter(_all(clear, QUALIFIED, 1), lambda x: ~last(x).rlike(_known(vocab.NOT_CALLS))),
    }
    return functions.withColumns({k: F.array_distinct(v) for k, v in facts.items()})


def return_statements(functions: DataFrame) -> DataFrame:
    """(FN, start_line, stmt) of each return statement's form."""
    return functions.select(*FN, "start_line", F.explode(F.array_distinct(F.transform(_all(F.col("masked"), r"\breturn\b[^;]*;"), squeezed))).alias("stmt"))


def _declared_names(stmt: Column) -> Column:
    """Names that a declaration declares; empty where the statement is none."""
    rest = F.regexp_extract(stmt, DECLARED + r"([^;{}()]+);?", 1)
    names = F.transform(F.split(rest, ","), lambda p: F.regexp_extract(F.trim(p), rf"[*&\s]*({IDENT})\s*(?:=|\[|;|$)", 1))
    return F.when(stmt.rlike(DECLARED + r"[^;{}()]+"), F.filter(names, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def definitions(functions: DataFrame) -> DataFrame:
    """(FN, variable, line, stmt): declared and assigned variables of each line."""
    stmt = F.col("stmt")
    plain = ~stmt.rlike("^(return|goto|if|for|while|switch|case|default)")
    names = F.array_distinct(F.filter(F.concat(_declared_names(stmt), _all(stmt, ASSIGNING, 1)), lambda x: ~x.rlike(_known(vocab.C_KEYWORDS))))
    return statements(functions).where(plain).select(*FN, F.explode(names).alias("variable"), "line", "stmt")


def uses(functions: DataFrame) -> DataFrame:
    """(FN, variable, line, stmt): identifiers of each line that are neither keywords nor the function's own name."""
    names = F.filter(F.array_distinct(_all(F.col("stmt"), rf"\b{IDENT}\b")), lambda x: ~x.rlike(_known(vocab.C_KEYWORDS)))
    return statements(functions).select(*FN, F.explode(names).alias("variable"), "line", "stmt").where("variable <> fn")


def pointer_variables(functions: DataFrame) -> DataFrame:
    """(FN, variable): names declared with a star."""
    stars = _all(F.col("stmt"), rf"(?<![=(,])\s\*+\s*({IDENT})", 1)
    rows = statements(functions).where(F.col("stmt").rlike(DECLARED + r"\**\s*[^;{}()]+") & F.col("stmt").contains("*"))
    return rows.select(*FN, F.explode(stars).alias("variable")).distinct()


def status_variables(functions: DataFrame) -> DataFrame:
    return definitions(functions).where(F.lower("variable").isin(vocab.STATUS_NAMES)).select(*FN, "variable").distinct()


def ownership(functions: DataFrame) -> DataFrame:
    """(FN, releases, transfers, borrows): what names and bodies suggest of a function's arguments."""
    name = F.lower("fn")
    primitive = F.col("body").rlike(vocab.RELEASE_PRIMITIVE)
    return functions.select(
        *FN,
        (name.rlike(any_of(vocab.RELEASE_HINTS)) | primitive).alias("releases"),
        name.rlike(any_of(vocab.TRANSFER_HINTS)).alias("transfers"),
        name.rlike(any_of(vocab.BORROW_HINTS)).alias("borrows"),
    )
