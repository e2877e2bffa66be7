"""What a C compiler's front end prints, as tables: syntax trees as JSON, control flow as text. Running it is the caller's."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..operators.lex import FUNCTION, masked

_HEADER = re.compile(r"\s*\[(B\d+)(?:\s+\((ENTRY|EXIT)\))?\]")
_STATEMENT = re.compile(r"\s+(?:\d+|T):\s+(.*)$")
_NEXT = re.compile(r"Succs \(\d+\):\s*(.*)$")
_NAME = re.compile(r"([A-Za-z_~]\w*(?:::[A-Za-z_~]\w*)?)$", re.A)


def _nodes(tree: dict) -> Iterator[dict]:
    """All nodes of a tree, parents first and in order, at any depth."""
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        yield node
        waiting += [x for x in reversed(node.get("inner") or []) if isinstance(x, dict)]


def _line(place: object, content: str) -> int | None:
    if not isinstance(place, dict):
        return None
    if place.get("line") is not None:
        return int(place["line"])
    return content.count("\n", 0, int(place["offset"])) + 1 if "offset" in place else None


def _lines(span: object, content: str) -> tuple[int, int] | None:
    span = span if isinstance(span, dict) else {}
    first, last = _line(span.get("begin"), content), _line(span.get("end"), content)
    return None if first is None or last is None else (first, last)


def _in_file(node: dict, path: str) -> bool:
    """Whether the node's place names the file, or a line without a file that isn't included from another."""
    for place in (node.get("loc"), (node.get("range") or {}).get("begin")):
        place = place if isinstance(place, dict) else {}
        if place.get("file"):
            if place["file"] == path or place["file"].endswith("/" + path) or path.endswith("/" + place["file"]):
                return True
        elif place.get("line") is not None and "includedFrom" not in place:
            return True
    return False


def functions_of(path: str, content: str, tree: dict) -> Iterator[tuple]:
    """Rows of FUNCTION: definitions in this file that the tree has."""
    lines = content.splitlines()
    cut = lambda a, b: "\n".join(lines[max(1, a) - 1 : max(a, b)])
    k = 0
    for node in _nodes(tree):
        body = next((x for x in node.get("inner") or [] if isinstance(x, dict) and x.get("kind") == "CompoundStmt"), None)
        if node.get("kind") not in vocab.FUNCTION_NODES or not node.get("name") or not (body or node.get("isThisDeclarationADefinition") is True) or not _in_file(node, path):
            continue
        span = _lines(node.get("range"), content)
        if span is None:
            continue
        whole = cut(*span)
        inner = _lines(body.get("range"), content) if body else None
        brace = whole.find("{")
        text = cut(*inner) if inner else whole[brace:] if brace >= 0 else whole
        text = text[max(0, text.find("{")) :]
        signature = " ".join(whole.split("{", 1)[0].split()) or (node.get("type") or {}).get("qualType") or node["name"]
        yield path, node["name"], k, span[0], span[0] + whole.count("\n", 0, max(0, brace)), span[1], signature, text, masked(text)
        k += 1


def clang_functions(trees: DataFrame) -> DataFrame:
    """Functions, as ``lex.functions`` gives them, of trees (path, content, ast as JSON). A broken or empty tree has none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, text in zip(b["path"], b["content"], b["ast"], strict=True):
                try:
                    tree = json.loads(text)
                except (TypeError, ValueError):
                    continue
                rows += functions_of(path, content or "", tree) if isinstance(tree, dict) else ()
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FUNCTION.split(", ")])

    return trees.select("path", "content", "ast").mapInPandas(parse, FUNCTION)


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Functions of the first parser with backend clang; of the second, with backend regex, for files in which the first found none."""
    rest = second.join(first.select("path").distinct(), "path", "left_anti").select(*second.columns)
    return first.withColumn("backend", F.lit("clang")).unionByName(rest.withColumn("backend", F.lit("regex")))


def sections_of(text: str) -> list[tuple[str, list[str]]]:
    """(function, lines) of a dump: a section begins at a line without indent that has a parenthesis."""
    out: list[tuple[str, list[str]]] = []
    for line in text.splitlines():
        if line and line[0] not in " [" and "(" in line:
            prefix = line.split("(", 1)[0].strip()
            m = _NAME.search(prefix)
            out.append((m[1] if m else prefix, []))
        elif out:
            out[-1][1].append(line)
    return out


def flow_of(fn: str, lines: list[str]) -> tuple[list[tuple[str, list[str]]], list[tuple[str, str, str]]]:
    """(block, statements) and (src, dst, edge), each once, of one section."""
    blocks: list[tuple[str, list[str]]] = []
    edges: dict[tuple[str, str, str], None] = {}
    for line in lines:
        if m := _HEADER.match(line):
            blocks.append((f"{fn}:{m[1]}", [f"<{m[2].lower()}>"] if m[2] else []))
        elif blocks and (m := _STATEMENT.match(line)):
            blocks[-1][1].append(m[1].strip())
        elif blocks and (m := _NEXT.search(line)):
            jump = re.search(r"\bgoto\b", " ".join(blocks[-1][1]))
            for to in re.findall(r"\bB\d+\b", m[1]):
                edges[blocks[-1][0], f"{fn}:{to}", "return" if to == "B0" else "goto" if jump else "control"] = None
    return [(b, s or ["<empty>"]) for b, s in blocks], list(edges)


def clang_flow(dumps: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (path, fn, k, block, stmt) and edges (path, fn, src, dst, edge) of dumps (path, cfg) for the functions (path, fn).

    A function's section is the first that has its name, or ends with it
    after a namespace. Functions without a section have no rows; others'
    control flow can be put in their place (see ``graph.control_edges``).
    """
    wanted = functions.select("path", "fn").distinct().groupBy("path").agg(F.collect_set("fn").alias("fns"))
    kind = "path string, fn string, what string, k int, a string, b string, edge string"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for path, text, fns in zip(x["path"], x["cfg"], x["fns"], strict=True):
                sections = sections_of(text or "")
                for fn in sorted(fns):
                    found = next((lines for name, lines in sections if name == fn or name.endswith(f"::{fn}")), None)
                    blocks, edges = flow_of(fn, found or [])
                    rows += [(path, fn, "block", k, block, s, None) for k, (block, stmts) in enumerate(blocks, 1) for s in stmts]
                    rows += [(path, fn, "edge", k, *e) for k, e in enumerate(edges, 1)]
            yield pd.DataFrame(rows, columns=["path", "fn", "what", "k", "a", "b", "edge"])

    both = dumps.join(wanted, "path").select("path", "cfg", "fns").mapInPandas(parse, kind)
    blocks = both.where("what = 'block'").select("path", "fn", "k", F.col("a").alias("block"), F.col("b").alias("stmt"))
    return blocks, both.where("what = 'edge'").select("path", "fn", F.col("a").alias("src"), F.col("b").alias("dst"), "edge")
