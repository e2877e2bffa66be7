"""From files to functions: the one step that needs a scanner, done on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .. import vocab

_QUIET = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)", re.S)
_NOT_NEWLINE = re.compile(r"[^\n]")
_BRACKET = re.compile(r"[(){}]")
_NAME = re.compile(r"([A-Za-z_~][\w~]*(?:::[A-Za-z_~][\w~]*)*)\s*\Z", re.A)
_CLOSES = {")": "(", "}": "{"}
FUNCTION = "path string, fn string, ordinal int, start_line int, body_line int, end_line int, signature string, body string, masked string"

#: Characters of bodies that go back to the executor together, about.
TOGETHER = 1 << 19


def masked(text: str) -> str:
    """Comments, strings and characters as blanks; length and line ends stay."""
    return _QUIET.sub(lambda m: _NOT_NEWLINE.sub(" ", m[0]), text)


def _partners(clear: str) -> dict[int, int]:
    """Place of each bracket's partner; brackets without one are left out."""
    out: dict[int, int] = {}
    waiting: dict[str, list[int]] = {"(": [], "{": []}
    for m in _BRACKET.finditer(clear):
        if m[0] in waiting:
            waiting[m[0]].append(m.start())
        elif waiting[_CLOSES[m[0]]]:
            a = waiting[_CLOSES[m[0]]].pop()
            out[a], out[m.start()] = m.start(), a
    return out


def _signature_start(clear: str, paren: int) -> int:
    """After the last ; or } before the parameters that isn't within <>, less blank and # lines."""
    depth, at = 0, paren - 1
    while at >= 0:
        c = clear[at]
        if c == ">":
            depth += 1
        elif c == "<":
            depth = max(0, depth - 1)
        elif not depth and c in ";}":
            break
        at -= 1
    start = at + 1
    while start < paren:
        stop = clear.find("\n", start, paren)
        line = clear[start : stop if stop >= 0 else paren].strip()
        if stop < 0 or line and not line.startswith("#"):
            break
        start = stop + 1
    return start


def _last_before(clear: str, at: int) -> int:
    """Place of the last character before ``at`` that isn't white space, -1 if there is none."""
    at -= 1
    while at >= 0 and clear[at].isspace():
        at -= 1
    return at


def _name_start(clear: str, paren: int) -> int:
    """Where the run of name characters and colons before the parameters begins."""
    at = _last_before(clear, paren)
    while at >= 0 and (clear[at].isascii() and clear[at].isalnum() or clear[at] in "_~:"):
        at -= 1
    return at + 1


def functions_in(text: str) -> Iterator[tuple]:
    """(name, start line, line of the brace, end line, signature, body, masked body) of each function, in order."""
    clear = masked(text)
    partner = _partners(clear)
    lines, counted = 1, 0
    at = clear.find("{")
    while at >= 0:
        follow = at + 1
        close = _last_before(clear, at)
        if close >= 0 and clear[close] == ")" and close in partner and at in partner:
            paren = partner[close]
            name = _NAME.search(clear, _name_start(clear, paren), paren)
            start = _signature_start(clear, paren)
            signature = " ".join(text[start:at].split())
            if name and signature and "=" not in signature.split("(", 1)[0] and name[1].split("::")[-1] not in vocab.CONTROL_KEYWORDS:
                first = start + len(text[start:at]) - len(text[start:at].lstrip())
                end = partner[at]
                lines += text.count("\n", counted, first)
                brace = lines + text.count("\n", first, at)
                last = brace + text.count("\n", at, end)
                yield name[1], lines, brace, last, signature, text[at : end + 1], clear[at : end + 1]
                counted = first
                follow = end + 1
        at = clear.find("{", follow)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32()}
    columns = [c.split() for c in FUNCTION.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[kind]) for v, (_, kind) in zip(zip(*rows, strict=True), columns, strict=True)], [name for name, _ in columns])


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of files as batches of their functions, of TOGETHER characters and a function at most."""
    rows, size = [], 0
    for b in batches:
        for path, content in zip(b.column(0), b.column(1), strict=True):
            for k, (name, *rest) in enumerate(functions_in(content.as_py() or "")):
                rows.append((path.as_py(), name, k, *rest))
                size += len(rest[-1])
                if size >= TOGETHER:
                    yield _batch(rows)
                    rows, size = [], 0
    if rows:
        yield _batch(rows)
    pa.default_memory_pool().release_unused()


def functions(files: DataFrame) -> DataFrame:
    """A row for each function of files (path, content), by order in its file.

    start_line is the signature's line, body_line that of the opening brace.
    Null and empty files have none. Masked bodies have blanks for comments
    and literals, place by place. Files are read one by one, and functions
    leave the worker as soon as their bodies reach TOGETHER.
    """
    return files.select("path", "content").mapInArrow(parsed, FUNCTION)
