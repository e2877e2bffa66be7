"""Unified diffs applied to tables of files, and patches taken through the stages of validation.

A tree is a table (path, content), and never changes: a patched tree is
another table, and going back to the clean one is reading the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .detect import Tables
from .lex import functions
from .validate import new_issues, repaired_paths, resource_issues, security_issues, semantic_issues

_HEAD = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
NOWHERE = "/dev/null"
#: The stages of a patch, in order; those of EXTERNAL are a caller's.
EXTERNAL = ["compile", "tests", "static_analysis"]
STAGES = ["apply_patch", *EXTERNAL, "resource_consistency", "semantic_equivalence", "security_regression"]


def _named(line: str) -> str:
    """The path of a --- or +++ line, without what follows a tab, a/ or b/ and leading dots."""
    path = line[4:].split("\t")[0].strip().replace("\\", "/")
    return path if path == NOWHERE else re.sub(r"^[ab]/", "", re.sub(r"^[./]+", "", path))


def sections_of(diff: str) -> list[tuple[str, str, str]]:
    """(old path, new path, hunks) of each file of a diff, in order."""
    out: list[tuple[str, str, list[str]]] = []
    old, left_old, left_new = None, 0, 0
    for line in diff.splitlines():
        if left_old > 0 or left_new > 0:  # inside a hunk, whatever the line looks like
            left_old -= line[:1] in (" ", "-", "")
            left_new -= line[:1] in (" ", "+", "")
            out[-1][2].append(line)
        elif line.startswith("--- "):
            old = _named(line)
        elif line.startswith("+++ ") and old is not None:
            out.append((old, _named(line), []))
        elif out and (m := _HEAD.match(line)):
            left_old, left_new = int(m[2] or 1), int(m[4] or 1)
            out[-1][2].append(line)
        elif out and line.startswith("\\"):
            out[-1][2].append(line)
    return [(a, b, "\n".join(hunks)) for a, b, hunks in out]


def applied(content: str, hunks: str) -> str:
    """The content after the hunks. A hunk stands at its line, or at the nearest place after the hunk before where its old lines are; ValueError if nowhere."""
    lines = content.split("\n")
    ends = content.endswith("\n") or not content
    if ends:
        lines.pop()
    out: list[str] = []
    at, moved = 0, 0
    todo = hunks.split("\n") if hunks else []
    k = 0
    while k < len(todo):
        head = _HEAD.match(todo[k])
        k += 1
        if not head:
            raise ValueError("patch is garbage at its line " + str(k))
        old, new = [], []
        while k < len(todo) and not _HEAD.match(todo[k]):
            mark, text = todo[k][:1], todo[k][1:]
            if mark in (" ", "-", ""):
                old.append(text)
            if mark in (" ", "+", ""):
                new.append(text)
            if mark == "\\":
                ends = todo[k - 1][:1] == "-"  # the old text lacks the last line end; else the new one does
            k += 1
        first = int(head[1]) - 1 + moved if int(head[2] or 1) else int(head[1]) + moved
        places = [p for p in range(at, len(lines) - len(old) + 1) if lines[p : p + len(old)] == old] if old else [min(max(first, at), len(lines))]
        if not places:
            raise ValueError(f"patch does not apply: hunk at line {head[1]}")
        place = min(places, key=lambda p: abs(p - first))
        moved += place - first
        out += lines[at:place] + new
        at = place + len(old)
    out += lines[at:]
    return "\n".join(out) + ("\n" if ends and out else "")


_SECTION = "patch_id {key}, ordinal int, old_path string, new_path string, hunks string"


def diff_sections(diffs: DataFrame) -> DataFrame:
    """(patch_id, ordinal, old_path, new_path, hunks): a row for each file that a diff (patch_id, diff) changes."""
    kind = _SECTION.format(key=diffs.schema["patch_id"].dataType.simpleString())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, *s) for i, diff in zip(b["patch_id"], b["diff"], strict=True) for k, s in enumerate(sections_of(diff or ""))]
            yield pd.DataFrame(rows, columns=["patch_id", "ordinal", "old_path", "new_path", "hunks"])

    return diffs.select("patch_id", "diff").mapInPandas(cut, kind)


def patched_files(files: DataFrame, diffs: DataFrame) -> DataFrame:
    """(patch_id, path, before, after, problem) of each file that a diff changes.

    Paths are repaired against the tree's (see ``repaired_paths``). before is
    null for a new file, after for a deleted one and where there is a problem.
    """
    sections = diff_sections(diffs).withColumn("path", F.when(F.col("old_path") == NOWHERE, F.col("new_path")).otherwise(F.col("old_path")))
    known = repaired_paths(sections.where(F.col("old_path") != NOWHERE).select("path").distinct(), files).select("path", "repaired")
    placed = sections.join(known, "path", "left").withColumn("path", F.coalesce("repaired", "path")).drop("repaired")
    joined = placed.join(files.select("path", F.col("content").alias("before")), "path", "left")
    kind = f"patch_id {diffs.schema['patch_id'].dataType.simpleString()}, path string, before string, after string, problem string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            after, problems = [], []
            for path, old, new, before, hunks in zip(b["path"], b["old_path"], b["new_path"], b["before"], b["hunks"], strict=True):
                text, problem = None, None
                try:
                    if old != NOWHERE and before is None:
                        raise ValueError(f"no such file: {path}")
                    if old == NOWHERE and before is not None:
                        raise ValueError(f"file exists already: {path}")
                    text = applied(before or "", hunks)
                    text = None if new == NOWHERE else text
                except ValueError as e:
                    problem = str(e)
                after.append(text)
                problems.append(problem)
            yield pd.DataFrame({"patch_id": b["patch_id"], "path": b["path"], "before": b["before"], "after": after, "problem": problems}, dtype=object).astype({"patch_id": b["patch_id"].dtype})

    return joined.select("patch_id", "path", "before", "hunks", "old_path", "new_path").mapInPandas(run, kind)


def apply_stage(diffs: DataFrame, patched: DataFrame) -> DataFrame:
    """(patch_id, passed, text): whether a whole diff applies; one that is empty or changes nothing doesn't pass."""
    changed = ~F.col("before").eqNullSafe(F.col("after"))
    files = patched.groupBy("patch_id").agg(F.min("problem").alias("problem"), F.count_if(changed & F.col("problem").isNull()).alias("changed"))
    out = diffs.select("patch_id", (~F.coalesce("diff", F.lit("")).rlike(r"\S")).alias("empty")).join(files, "patch_id", "left")
    text = F.when(F.col("empty"), "empty patch").when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("changed").isNull(), "patch is garbage").when(F.col("changed") == 0, "patch made no project changes").otherwise("applied")
    return out.select("patch_id", (text == "applied").alias("passed"), text.alias("text"))


def patched_tree(files: DataFrame, patched: DataFrame, patch_id: object) -> DataFrame:
    """The tree (path, content) with one patch."""
    own = patched.where(F.col("patch_id") == F.lit(patch_id))
    return files.select("path", "content").join(own.select("path"), "path", "left_anti").unionByName(own.where("after IS NOT NULL").select("path", F.col("after").alias("content")))


def validate_patches(files: DataFrame, diffs: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """(patch_id, ordinal, stage, passed, text): the stages of each patch; a patch that doesn't apply has the first alone.

    external: (patch_id, stage, passed, text) of compilers, tests and other
    tools that a caller has run; a stage without a row passes with a warning.
    The checkers read all patches' files in one pass, each under its patch;
    both versions' functions, lines and events are made once, laid out alike.
    """
    patched = materialise(patched_files(files, diffs), "patched")
    first = materialise(apply_stage(diffs, patched), "applied")
    good = first.where("passed").select("patch_id")
    own = F.concat(F.to_json(F.struct("patch_id")), F.lit("\n"), "path")
    version = lambda c: patched.join(good, "patch_id", "left_semi").where(F.col(c).isNotNull()).select(own.alias("path"), F.col(c).alias("content"))
    tb, ta = Tables.of(functions(version("before"))).keep(), Tables.of(functions(version("after"))).keep()
    b, a = tb.functions, ta.functions
    issues = [("resource_consistency", new_issues(resource_issues(tb), resource_issues(ta))), ("semantic_equivalence", semantic_issues(b, a)), ("security_regression", security_issues(tb, ta))]
    key = diffs.schema["patch_id"].dataType.simpleString()
    found = None
    for name, rows in issues:
        patch = F.from_json(F.split("path", "\n", 2)[0], f"patch_id {key}")["patch_id"]
        rows = rows.select(patch.alias("patch_id"), F.lit(name).alias("stage"), F.concat_ws(": ", F.split("path", "\n", 2)[1], "fn", "issue").alias("issue"))
        found = rows if found is None else found.unionByName(rows)
    found = ta.finish(found, "issues")
    tb.release()
    found = found.groupBy("patch_id", "stage").agg(F.array_join(F.array_sort(F.collect_list("issue")), "; ").alias("text")).withColumn("passed", F.lit(False))
    if external is not None:
        found = found.unionByName(external.select("patch_id", "stage", "text", F.coalesce("passed", F.lit(False)).alias("passed")))
    names = F.array(*map(F.lit, STAGES))
    later = good.select("patch_id", F.posexplode(names).alias("ordinal", "stage")).where("ordinal > 0").join(found, ["patch_id", "stage"], "left")
    silent = F.when(F.col("stage").isin(EXTERNAL), "nothing to run").otherwise("")
    later = later.select("patch_id", "ordinal", "stage", F.coalesce("passed", F.lit(True)).alias("passed"), F.coalesce("text", silent).alias("text"))
    return first.select("patch_id", F.lit(0).alias("ordinal"), F.lit(STAGES[0]).alias("stage"), "passed", "text").unionByName(later)
