"""Patches, compilers' output, reports and record files on cases that tables don't hold."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from codelens.operators import patching, runs, tables
from codelens.plans import repair, report
from codelens.sources import clang, records
from codelens.streaming import merge


def test_hunks_move_and_keep_the_last_line_end():
    text = "a\nb\nc\nd\ne\n"
    assert patching.applied(text, "@@ -1,2 +1,2 @@\n c\n-d\n+D") == "a\nb\nc\nD\ne\n"
    assert patching.applied(text, "@@ -1 +1,2 @@\n-a\n+a1\n+a2\n@@ -5 +6 @@\n-e\n+E") == "a1\na2\nb\nc\nd\nE\n"
    assert patching.applied("x", "@@ -1 +1 @@\n-x\n\\ No newline at end of file\n+y") == "y\n"
    assert patching.applied("x\n", "@@ -1 +1 @@\n-x\n+y\n\\ No newline at end of file") == "y"
    assert patching.applied("", "@@ -0,0 +1,2 @@\n+p\n+q") == "p\nq\n"
    assert patching.applied("a\nb\n", "@@ -1,0 +2 @@\n+x") == "a\nx\nb\n"
    assert patching.applied("a\n", "@@ -1 +0,0 @@\n-a") == ""
    for bad in ("@@ -1 +1 @@\n-z\n+y", "junk"):
        with pytest.raises(ValueError, match="patch"):
            patching.applied(text, bad)


def test_new_and_deleted_files_and_lines_that_look_like_heads(spark):
    files = spark.createDataFrame([("src/a.c", "-- x\nb\n"), ("src/old.c", "o\n"), ("src/c.c", "c\n")], "path string, content string")
    diff = "--- a/a.c\n+++ b/a.c\n@@ -1,2 +1,1 @@\n--- x\n b\n--- /dev/null\n+++ b/src/new.c\n@@ -0,0 +1 @@\n+n\n--- a/src/old.c\n+++ /dev/null\n@@ -1 +0,0 @@\n-o\n"
    diffs = spark.createDataFrame([(1, diff), (2, "--- /dev/null\n+++ b/src/c.c\n@@ -0,0 +1 @@\n+n\n"), (3, None), (4, "no diff at all")], "patch_id long, diff string")
    patched = patching.patched_files(files, diffs)
    assert {(r.path, r.after) for r in patched.where("patch_id = 1").collect()} == {("src/a.c", "b\n"), ("src/new.c", "n\n"), ("src/old.c", None)}
    assert {(r.patch_id, r.passed, r.text) for r in patching.apply_stage(diffs, patched).collect()} == {(1, True, "applied"), (2, False, "file exists already: src/c.c"), (3, False, "empty patch"), (4, False, "patch is garbage")}
    assert {tuple(r) for r in patching.patched_tree(files, patched, 1).collect()} == {("src/a.c", "b\n"), ("src/new.c", "n\n"), ("src/c.c", "c\n")}
    external = spark.createDataFrame([(1, "tests", False, "2 failed")], "patch_id long, stage string, passed boolean, text string")
    stages = {(r.patch_id, r.stage): (r.passed, r.text) for r in patching.validate_patches(files, diffs, external).collect()}
    assert stages[1, "tests"] == (False, "2 failed") and stages[1, "compile"] == (True, "nothing to run") and (2, "compile") not in stages and len(stages) == 3 + 7


def test_edit_plans_out_of_answers(spark):
    plan = [{"file": "a/x.c", "line": 2, "new": "two"}, {"path": "x.c", "operation": "insert-after", "anchor": "one\n", "text": "and a half"}]
    answers = [("1", f"Here:\n```json\n{json.dumps({'edits': plan})}\n```", ["x.c"]), ("2", f"so {json.dumps({'edits': [{'old': 'one', 'text': 'uno'}]})} done", ["x.c"]), ("3", json.dumps([{"old": "a"}]), ["x.c", "y.c"]), ("4", "nothing", ["x.c"])]
    rows = repair.edits_by_file(spark.createDataFrame(answers, "patch_id string, answer string, files array<string>"))
    got = {r.patch_id: (r.path, r.edits) for r in rows.collect()}
    assert got["3"] == got["4"] == (None, None) and got["1"][0] == got["2"][0] == "x.c"
    assert repair.edited("one\ntwo!\n", json.loads(got["1"][1])) == "one\nand a half\ntwo\n"
    assert repair.edited("one\n", json.loads(got["2"][1])) == "uno\n"
    assert repair.edited("a\nb\nc", [{"start_line": 1, "end_line": 2, "operation": "remove"}, {"start_line": 3, "operation": "insert_before", "text": "x"}]) == "x\nc"
    assert repair.edited("a", [{"old": "a", "operation": "turn"}]) is repair.edited("a", [{"line": 1, "operation": "turn"}]) is None


def test_trees_of_compilers(spark):
    body = {"kind": "CompoundStmt", "range": {"begin": {"offset": 18}, "end": {"offset": 33}}}
    definition = {"kind": "CXXMethodDecl", "name": "f", "loc": {"file": "/w/src/a.cc", "offset": 4}, "range": {"begin": {"offset": 0}, "end": {"offset": 33}}, "inner": [{"kind": "ParmVarDecl"}, body]}
    other = {**definition, "name": "g", "loc": {"file": "/usr/h.h", "line": 1}, "range": {"begin": {"file": "/usr/h.h", "line": 1}, "end": {"line": 2}}}
    deep = {"kind": "NamespaceDecl", "inner": [definition, {"kind": "FunctionDecl", "name": "d", "loc": {"line": 1}}, other]}
    for _ in range(3000):
        deep = {"kind": "NamespaceDecl", "inner": [deep]}
    rows = list(clang.functions_of("src/a.cc", "int A::f(\n  int x) {\n  return x;\n}\n", deep))
    assert [(r[1], r[3], r[5], r[6]) for r in rows] == [("f", 1, 4, "int A::f( int x)")] and rows[0][7].startswith("{")
    trees = spark.createDataFrame([("a.c", "x", None), ("b.c", "x", "[]"), ("c.c", None, "{}")], "path string, content string, ast string")
    assert clang.clang_functions(trees).count() == 0


def test_report_files(spark, tmp_path):
    opportunities = spark.createDataFrame([("a", 1, "dead_code", "Gone.", None), ("b", 2, "resource_x", "Leak.", None)], "opportunity_id string, number int, kind string, description string, safe_to_remove boolean")
    plans = spark.createDataFrame([], "opportunity_id string, intent string, strategy string, constraint string")
    diff = "--- a/x.c\n+++ b/x.c\n@@ -1 +1 @@\n-a\n+b\n"
    candidates = spark.createDataFrame([("a", "c1", 1, True, diff, "Better."), ("z", "c2", 1, None, diff, None)], "opportunity_id string, candidate_id string, place int, selected boolean, diff string, explanation string")
    validations = spark.createDataFrame([("a", True, [], []), ("b", None, [], ["log"])], "opportunity_id string, passed boolean, counterexamples array<string>, logs array<string>")
    patches = report.patch_records(opportunities, candidates)
    rows = report.report(opportunities, plans, patches, validations)
    a, b = rows.orderBy("number").collect()
    assert (a.explanation, a.files_changed, a.lines_added, a.failed_candidates, a.selected_paths) == ("Gone. Better.", ["x.c"], 1, [], ["patches/opportunity-001-selected.diff"])
    assert (b.failed_candidates, b.failure_reason, b.candidate_ids) == ([None], "log", [])
    assert {r.candidate_path for r in patches.collect()} == {"patches/opportunity-001-candidate-001.diff", "patches/opportunity-003-candidate-001.diff"}
    assert tuple(report.summary(opportunities, plans, patches, validations).first()) == (2, 0, 2, 1, 2, 1)
    report.write_report(rows, patches, str(tmp_path))
    assert "## 1. dead_code" in "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/report.md").collect())
    assert spark.read.text(f"{tmp_path}/patches").select("file").distinct().count() == 3
    assert [r.text for r in report.console(rows, "p").orderBy("number").collect()][0] == "p: 2 opportunities"


def test_inputs_and_json(spark, tmp_path):
    for d in ("run1", "run2"):
        (tmp_path / d).mkdir()
    (tmp_path / "run1" / "results.jsonl").write_text("{}")
    (tmp_path / "one.jsonl").write_text("{}")
    assert [x.rsplit("/", 1)[-1] for x in records.result_folders(spark, "run*, other", str(tmp_path))] == ["run1", "run2", "other"]
    assert [x.rsplit("/", 1)[-1] for x in records.input_files(spark, ["run1", "run2", "one.jsonl", "none"], "results.jsonl", str(tmp_path))] == ["results.jsonl", "one.jsonl"]
    assert records.json_ready(spark.createDataFrame([(1, None)], "b int, a string")).first()[0] == '{"a":null,"b":1}'


def test_stream_fails_on_a_broken_line_that_is_not_the_last(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"work_id": "%s", "project": "p", "passed": true, "seconds": 1.0, "written_at": "2024-01-01T00:00:00"}\n'
    (tmp_path / "in" / "a.json").write_text(line % "a" + '{"work_id": "c\n' + line % "b")
    query = merge.merge_into(merge.result_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    with pytest.raises(Exception, match="(?i)malformed|json"):
        query.awaitTermination(120)


def test_claims_grow_stale(spark):
    queue = spark.createDataFrame([(k,) for k in "abcd"], "work_id string")
    done = spark.createDataFrame([("a",)], "work_id string")
    claims = spark.createDataFrame([("b", 10.0), ("c", 95.0)], "work_id string, reserved_at double")
    free = lambda stale: sorted(r.work_id for r in runs.claimable(queue, done, claims, F.lit(100.0), stale).collect())
    assert free(50) == ["b", "d"] and free(0) == ["d"]


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_nearest_rank_equals_a_sorted_list(spark, n):
    values = [round((k * 37 % 101) ** 3 / 7, 3) for k in range(n)] + [None]
    rows = spark.createDataFrame([("g", v) for v in values] + [("h", 5.0)] * 3, "g string, v double")
    got = {r.g: r.p for r in tables.nearest_rank(rows, ["g"], "v", 0.95, "p", parts=8).collect()}
    ordered = sorted(v for v in values if v is not None)
    assert got == {"g": pytest.approx(ordered[round((n - 1) * 0.95)]), "h": 5.0}


def test_rounds_tell_failures_and_stop_at_the_first_that_passes(spark):
    from codelens.plans.rounds import NONE_MADE, repair_rounds

    heard = {}

    def generate(open_, n):
        rows = {r.opportunity_id: r.messages for r in open_.collect()}
        heard[n] = rows
        made = {0: [("a", 1, "x"), ("a", 2, "ok"), ("a", 3, "ok"), ("b", 1, "x"), ("b", 2, "y")], 1: [("b", 1, "y")], 2: [("b", 1, "ok"), ("c", 1, None)]}[n]
        return spark.createDataFrame([m for m in made if m[0] in rows], "opportunity_id string, candidate int, text string")

    validate = lambda made: made.selectExpr("*", "text = 'ok' AS passed", "array(text) AS logs")
    ids = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "opportunity_id string")
    got = {r.opportunity_id: (r.round, r.candidate, r.tried, r.messages) for r in repair_rounds(ids, generate, validate).collect()}
    assert got["a"] == (0, 2, 2, []) and got["b"] == (2, 1, 4, [])
    assert got["c"][:3] == (None, None, 1) and got[None] == (None, None, 0, [NONE_MADE])
    assert set(heard[0]) == {"a", "b", "c", None} and set(heard[1]) == {"b", "c", None}
    assert heard[0]["b"] == [] and heard[1]["b"] == ["candidate 1: x", "candidate 2: y"] and heard[2]["b"] == ["candidate 1: y"] and heard[1]["c"] == [NONE_MADE]
    assert repair_rounds(ids.where("opportunity_id = 'a'"), generate, validate).count() == 1 and max(heard) == 2
    assert repair_rounds(ids.limit(0), generate, validate).count() == 0
