"""Plans for findings, edits and diffs, and the choice among patch candidates.

Models and build tools are columns that a caller brings; here is what is
computed around them.
"""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUNK_HEAD = re.compile(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@(.*)$")


def intent(kind: Column) -> Column:
    return (
        F.when(kind.startswith("goto"), "simplify control flow and cleanup").when(kind == "duplicate_check", "remove a repeated check").when(kind == "dead_code", "remove unreachable code")
        .when(kind.startswith("resource"), "balance resource handling").otherwise("make the code safer without changing what it does")
    )


def plans(findings: DataFrame) -> DataFrame:
    """``findings`` with intent, invariants, steps and strategy, all from their kind and severity."""
    resource = F.col("kind").startswith("resource")
    keep = F.array(F.lit("keep public signatures"), F.lit("keep return values"), F.when(resource | F.col("kind").startswith("goto"), F.lit("release each resource once on every path")), F.when(F.col("kind") == "duplicate_check", F.lit("keep the first check")))
    steps = F.array(F.lit("apply"), F.lit("compile"), F.lit("test"), F.when(resource, F.lit("resource_consistency")), F.lit("semantic_equivalence"), F.lit("security_regression"))
    present = lambda a: F.array_distinct(F.filter(a, lambda x: x.isNotNull()))
    return findings.withColumns({"intent": intent(F.col("kind")), "invariants": present(keep), "steps": present(steps), "strategy": F.when(F.col("severity").isin("critical", "high"), "smallest patch at the place of the finding").otherwise("smallest patch; none if unsure")})


def prompts(plans: DataFrame) -> DataFrame:
    """A JSON payload for each plan."""
    return plans.withColumn("prompt", F.to_json(F.struct("id", "kind", "path", "fn", "line", "description", "summary", "intent", "invariants", "steps", "strategy")))


def diff_in(text: Column) -> Column:
    """A unified diff out of an answer: a fenced block, else from its first header on; null without one."""
    fenced = F.regexp_extract(text, r"(?s)```(?:diff|patch)?\s*\n(.*?)```", 1)
    bare = F.regexp_extract(text, r"(?ms)^(?:diff --git |--- )[^\n]*\n.*", 0)
    found = F.when(fenced.rlike(r"(?m)^(--- |diff --git |@@ )"), fenced).otherwise(bare)
    return F.when(found != "", found)


def patch_confidence(valid: Column, empty: Column, aggressive: Column, edited: Column) -> Column:
    base = F.when(aggressive, 0.62).otherwise(0.72) + F.when(edited, 0.05).otherwise(0.0)
    return F.when(empty, 0.0).when(~valid, 0.05).otherwise(F.least(F.lit(0.95), base))


def recounted(diff: str) -> str:
    """The diff with the line counts of its hunks put right."""
    out: list[str] = []
    head, old, new = None, 0, 0

    def close() -> None:
        if head is not None:
            m = HUNK_HEAD.match(out[head])
            out[head] = f"@@ -{m[1]},{old} +{m[2]},{new} @@{m[3]}"

    for line in diff.split("\n"):
        if HUNK_HEAD.match(line):
            close()
            head, old, new = len(out), 0, 0
        elif head is not None and line.startswith(("--- ", "diff ")):
            close()
            head = None
        elif head is not None:
            old += line[:1] in (" ", "-")
            new += line[:1] in (" ", "+")
        out.append(line)
    close()
    return "\n".join(out)


#: Other names of edit operations.
OPERATIONS = {"insert-before": "insert_before", "insert-after": "insert_after", "remove": "delete"}


def edit_plan(answer: str | None) -> list[dict] | None:
    """The edits that an answer holds: JSON in a fence, as the whole text or between the outermost braces; an object with edits, or a list."""
    text = (answer or "").strip()
    if m := re.search(r"```(?:json)?\s*(.*?)```", text, re.S):
        text = m[1].strip()
    for part in (text, text[max(0, text.find("{")) : text.rfind("}") + 1]):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        edits = found.get("edits") if isinstance(found, dict) else found
        if isinstance(edits, list):
            return edits
    return None


def _operation(edit: dict) -> str:
    name = str(edit.get("operation") or edit.get("type") or "replace").strip().lower()
    return OPERATIONS.get(name, name)


def _new_text(edit: dict) -> str:
    given = edit.get("text")
    return str(given if given is not None else edit.get("new", ""))


def _first_line(edit: dict) -> int:
    return int(edit.get("start_line") or edit.get("line") or 0)


def edited(content: str, edits: list[dict]) -> str | None:
    """A file after its edits: by lines from the bottom up, then by text, first occurrence each. None if one doesn't fit."""
    numbered = [e for e in edits if e.get("start_line") is not None or e.get("line") is not None]
    lines, ends = content.splitlines(), content.endswith("\n")
    for e in sorted(numbered, key=_first_line, reverse=True):
        first = _first_line(e)
        last = int(e.get("end_line") or first)
        places = {"replace": (first - 1, last), "delete": (first - 1, last), "insert_before": (first - 1, first - 1), "insert_after": (last, last)}
        if not 1 <= first <= last <= len(lines) or _operation(e) not in places:
            return None
        a, b = places[_operation(e)]
        lines[a:b] = [] if _operation(e) == "delete" else _new_text(e).splitlines()
    out = "\n".join(lines) + ("\n" if ends else "") if numbered else content
    for e in edits:
        if e in numbered:
            continue
        how, text = _operation(e), _new_text(e)
        inserts = how in ("insert_before", "insert_after")
        old = str((e.get("anchor") or e.get("old") if inserts else e.get("old") or e.get("anchor")) or "")
        if not old or old not in out or not inserts and how not in ("replace", "delete"):
            return None
        whole_lines = text if text.endswith("\n") else text + "\n"
        out = out.replace(old, {"replace": text, "delete": "", "insert_before": whole_lines + old, "insert_after": old + whole_lines}[how], 1)
    return out


def edits_by_file(answers: DataFrame) -> DataFrame:
    """(patch_id, path, edits as JSON) of answers (patch_id, answer, files): a row for each file that an answer edits.

    An edit names its file; without one it is the only one of ``files``, the
    plan's files. An answer without a plan, or with an edit whose file isn't
    known, has one row with a null path.
    """

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for patch, answer, files in zip(b["patch_id"], b["answer"], b["files"], strict=True):
                edits = edit_plan(answer)
                only = files[0] if files is not None and len(files) == 1 else None
                paths = [(e.get("file") or e.get("path") or only) if isinstance(e, dict) else None for e in edits or []]
                if not paths or None in paths:
                    rows.append((patch, None, None))
                    continue
                clean = [re.sub(r"^[ab]/", "", str(p).strip()) for p in paths]
                rows += [(patch, p, json.dumps([e for e, q in zip(edits, clean, strict=True) if q == p])) for p in dict.fromkeys(clean)]
            yield pd.DataFrame(rows, columns=["patch_id", "path", "edits"])

    return answers.select("patch_id", "answer", "files").mapInPandas(made, "patch_id string, path string, edits string")


def edit_diffs(edits: DataFrame, files: DataFrame) -> DataFrame:
    """(patch_id, path, diff) of edit plans (patch_id, path, edits as JSON) against files (path, content); null where an edit doesn't fit."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            diffs = []
            for path, content, text in zip(b["path"], b["content"], b["edits"], strict=True):
                try:
                    new = edited(content, json.loads(text))
                except (ValueError, TypeError, AttributeError):
                    new = None
                diffs.append(None if new is None else "".join(difflib.unified_diff(content.splitlines(True), new.splitlines(True), f"a/{path}", f"b/{path}")))
            yield pd.DataFrame({"patch_id": b["patch_id"], "path": b["path"], "diff": diffs})

    return edits.join(files, "path").select("patch_id", "path", "content", "edits").mapInPandas(made, "patch_id string, path string, diff string")


def chosen_patches(candidates: DataFrame) -> DataFrame:
    """Of each opportunity's candidates (opportunity_id, iteration, candidate, passed, diff) the first that passed; all counted."""
    order = Window.partitionBy("opportunity_id").orderBy("iteration", "candidate")
    tried = candidates.withColumn("tried", F.count(F.lit(1)).over(Window.partitionBy("opportunity_id")))
    return tried.where(F.coalesce("passed", F.lit(False))).withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def diff_statistics(diffs: DataFrame) -> DataFrame:
    """(patch_id, files, added, removed)."""
    lines = F.split("diff", "\n")
    count = lambda test: F.size(F.filter(lines, test))
    return diffs.select("patch_id", count(lambda x: x.startswith("+++ ")).alias("files"), count(lambda x: x.startswith("+") & ~x.startswith("+++")).alias("added"), count(lambda x: x.startswith("-") & ~x.startswith("---")).alias("removed"))


def narrative(kind: Column, passed: Column) -> Column:
    """A sentence for a report."""
    return F.concat(intent(kind), F.when(F.coalesce(passed, F.lit(False)), "; validated").otherwise("; not validated"))
