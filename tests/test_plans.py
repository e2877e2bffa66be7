from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from codelens.functions import scalars as S
from codelens.operators import detect, findings, review, tables
from codelens.operators.lex import functions
from codelens.plans import repair, scan
from codelens.sources import builds, corpus, records
from codelens.streaming import merge


def test_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src" / "a.c").write_bytes(b"int f(char *d, char *s) {\r\n    strcpy(d, s);\r\n}\r\n")
    (tmp_path / "src" / "bad.c").write_bytes(b"int g(void) { \xff\xfe }")
    (tmp_path / "src" / "note.txt").write_text("int h(void) { gets(x); }")
    (tmp_path / ".git" / "b.c").write_text("int i(char *s) { gets(s); }")
    found = scan.Scan.of(spark, str(tmp_path), detectors=["unsafe_call"]).findings().collect()
    assert [(r.fn, r.line) for r in found] == [("f", 2)] and "calls=strcpy" in found[0].summary


def test_validation_stages(spark):
    old = spark.createDataFrame([("a.c", "int f(void) {\n    return 0;\n}")], "path string, content string")
    new = spark.createDataFrame([("a.c", "int f(void) {\n    char *p = malloc(3);\n    return 0;\n}")], "path string, content string")
    assert {r.stage: r.passed for r in scan.validated(old, old).collect()} == {"resource_consistency": True, "semantic_equivalence": True, "security_regression": True}
    got = {r.stage: r.passed for r in scan.validated(old, new).collect()}
    assert got == {"resource_consistency": False, "semantic_equivalence": True, "security_regression": False}


def test_edits_become_diffs(spark):
    files = spark.createDataFrame([("a.c", "one\ntwo\nthree\n")], "path string, content string")
    edits = [[{"operation": "replace", "start_line": 2, "end_line": 2, "text": "2"}, {"operation": "insert_after", "old": "three", "text": "!"}], [{"start_line": 9, "text": "x"}], [{"old": "nowhere", "text": "x"}]]
    rows = spark.createDataFrame([(str(k), "a.c", json.dumps(e)) for k, e in enumerate(edits)] + [("n", "a.c", "no json")], "patch_id string, path string, edits string")
    got = {r.patch_id: r.diff for r in repair.edit_diffs(rows, files).collect()}
    assert "-two\n-three\n+2\n+three!\n+\n" in got["0"]
    assert got["1"] is None and got["2"] is None and got["n"] is None
    stats = repair.diff_statistics(spark.createDataFrame([("0", got["0"])], "patch_id string, diff string")).first()
    assert tuple(stats) == ("0", 1, 3, 2)


def test_hunk_counts_are_put_right():
    assert repair.recounted("--- a\n+++ b\n@@ -1,9 +1,9 @@ f\n x\n-y\n+z\n+w") == "--- a\n+++ b\n@@ -1,2 +1,3 @@ f\n x\n-y\n+z\n+w"


def test_answers_and_plans(spark):
    rows = spark.createDataFrame([("words\n```diff\n--- a\n+++ b\n@@ -1 +1 @@\n```\n",), ("--- a\n+++ b\n",), ("none",), (None,)], "t string")
    assert [bool(r[0]) for r in rows.select(repair.diff_in(F.col("t"))).collect()] == [True, True, False, False]
    plan = repair.plans(spark.createDataFrame([("resource_imbalance", "high"), ("dead_code", "low")], "kind string, severity string")).collect()
    assert "release each resource once on every path" in plan[0].invariants and "resource_consistency" not in plan[1].steps


def test_candidates(spark):
    rows = spark.createDataFrame([("o", 0, 0, False, "a"), ("o", 0, 1, True, "b"), ("o", 1, 0, True, "c"), ("p", 0, 0, None, "d")], "opportunity_id string, iteration int, candidate int, passed boolean, diff string")
    assert [(r.opportunity_id, r.diff, r.tried) for r in repair.chosen_patches(rows).collect()] == [("o", "b", 3)]


def test_lines_with_a_cut_off_end(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"work_id": "a"}\n{"work_id": "b"}\n{"work_id": "c')
    got = records.read_lines(spark, str(tmp_path / "r.jsonl"), "work_id string", strict=False)
    assert sorted(r.work_id for r in got.collect()) == ["a", "b"]


def test_rendered_tables(spark):
    rows = spark.createDataFrame([("a_b", 1)], "name string, n int")
    assert records.markdown(rows, ["name", "n"]) == "| name | n |\n| --- | --- |\n| a_b | 1 |"
    assert r"a\_b & 1 \\" in records.latex(rows, ["name", "n"])


def test_shards_are_whole_and_even(spark):
    sizes = spark.createDataFrame([(f"p{k}", n) for k, n in enumerate([9, 7, 6, 5, 5, 1])], "project string, n long")
    got = tables.assign_shards(sizes, 2).collect()
    loads = {w: sum(r.n for r in got if r.worker == w) for w in (0, 1)}
    assert len(got) == 6 and loads == {0: 15, 1: 18}


def test_merges_keep_the_last(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "n"), (None, 2, "m")], "work_id string, at int, v string")
    assert sorted((r.work_id or "", r.v) for r in tables.last_written(rows, "work_id", ["at"]).collect()) == [("", "m"), ("", "n"), ("a", "y")]


def test_scores(spark):
    row = spark.range(1).select(S.evidence_label(F.lit(0.72) + F.lit(0.08)), S.evidence_label(F.lit(0.8)), S.verdict(F.lit(2.0)), S.gated(F.lit("critical"), F.lit("low")), S.gated(F.lit("odd"), F.lit("high")), S.listed(F.array()), S.rate(F.lit(1), F.lit(0)), S.ceil_div(F.lit(7), F.lit(3))).first()
    assert tuple(row) == ("medium", "high", "true_positive", "medium", "medium", "none", 0.0, 3)


def test_stream_takes_each_item_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"work_id": "%s", "project": "p", "passed": true, "seconds": 1.0, "written_at": "2024-01-01T00:00:0%d"}\n'
    (tmp_path / "in" / "a.json").write_text(line % ("a", 1) + line % ("b", 2) + line % ("a", 3) + '{"work_id": "c')
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        merge.merge_into(merge.result_stream(spark, str(tmp_path / "in")), out, check).awaitTermination(120)
    assert sorted(r.work_id for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_compile_database(spark, tmp_path):
    (tmp_path / "compile_commands.json").write_text(json.dumps([{"directory": "/w", "file": "a.c", "command": "cc -Ix -DN='a b' -c a.c -o a.o -MF d"}, {"directory": "/w", "file": "/w/b.c", "arguments": ["cc", "-O2", "-oout", "/w/b.c"]}]))
    got = {r.file: r.arguments for r in builds.compile_arguments(spark, str(tmp_path / "compile_commands.json")).collect()}
    assert got == {"/w/a.c": ["-Ix", "-DN='a b'"], "/w/b.c": ["-O2"]}


def test_paths_stay_inside(spark):
    rows = spark.createDataFrame([("/p/a/../b.c",), ("/p/./c",)], "path string")
    assert [r[0] for r in rows.select(builds.inside("/p", F.col("path"))).collect()] == ["/p/b.c", "/p/c"]
    with pytest.raises(Exception, match="outside the project"):
        spark.createDataFrame([("/p/../q",)], "path string").select(builds.inside("/p", F.col("path"))).collect()


def test_cache_is_keyed_by_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.c").write_text("x")
    files = lambda: spark.read.format("binaryFile").load(str(tmp_path / "in"))
    key = builds.fingerprint(files())
    assert len(key) == 24 and key == builds.fingerprint(files()) != builds.fingerprint(files(), "other")
    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("n")
    for _ in range(2):
        assert builds.cached(spark, str(tmp_path / "cache"), key, "t", make).count() == 3
    assert made == [1]


def test_nested_results(spark):
    kind = "work_id string, stages map<string, struct<passed: boolean, stages: map<string, boolean>>>"
    rows = spark.createDataFrame([("a", {"tests": (False, None), "compile": (True, None), "failure_taxonomy": (None, None), "candidate_1": (None, {"apply_patch": False, "tests": True})})], kind)
    assert {tuple(r) for r in review.failed_stages(rows).collect()} == {("a", "tests"), ("a", "apply_patch")}


def test_review_predicates(spark):
    row = spark.range(1).select(
        review.is_unsafe_review(F.lit(None).cast("boolean"), F.lit(True), F.lit(False)), review.is_unsafe_review(*[F.lit(None).cast("boolean")] * 3), review.is_false_accept(F.lit("incorrect"), F.lit(False)), review.is_false_accept(F.lit(None), F.lit(None).cast("boolean")),
        review.is_model_error(F.lit("INSUFFICIENT_QUOTA")), review.is_model_error(F.lit(None).cast("string")), review.is_test_file(F.lit("src/tests/a.c")), review.is_test_file(F.lit("src/latest.c")),
    ).first()
    assert tuple(row) == (True, False, True, False, True, False, True, False)


def test_resource_evidence(spark):
    t = detect.Tables.of(functions(spark.createDataFrame([("a.c", "int f(char *p) {\n    free(p);\n" + "    x();\n" * 30 + "}")], "path string, content string")))
    rows = t.lines.where("line IN (5, 30)").select("path", "fn", "ordinal", "line")
    assert {r.line: r.near_resource for r in review.with_resource_evidence(rows, t.events).collect()} == {5: True, 30: False}


def test_languages_and_build_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name in ("Makefile", "b/Makefile", "b/compile_commands.json", "x.c"):
        (tmp_path / name).write_text("x")
    got = {r.name: r.files for r in corpus.build_files(spark, str(tmp_path)).collect()}
    assert got == {"Makefile": 2, "compile_commands.json": 1}
    rows = spark.createDataFrame([("a.C",), ("a.hpp",), ("a.py",), ("a.h",)], "path string")
    assert [r[0] for r in rows.select(corpus.language()).collect()] == ["c", "cpp", "unknown", "c"]


def test_report_numbers_follow_the_ranking(spark):
    rows = [("p", "f", 0, "k", line, sev, conf, f"d{line}", str(line)) for line, sev, conf in [(1, "low", 0.9), (2, "critical", 0.5), (3, "high", 0.7), (4, "high", 0.8)]]
    found = spark.createDataFrame(rows, "path string, fn string, ordinal int, kind string, line int, severity string, confidence double, description string, id string")
    assert {r.line: r.report_index for r in findings.numbered(found).collect()} == {2: 1, 4: 2, 3: 3, 1: 4}


SMALL = "/root/testdata/sf0.001"


def _exchanges(df):
    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        below = 0 if "InMemory" in node.nodeName() else sum(walk(node.children().apply(i)) for i in range(node.children().size()))
        return below + (node.nodeName() == "Exchange")

    return walk(df._jdf.queryExecution().executedPlan())


def test_detectors_and_checkers_share_one_layout(spark, monkeypatch):
    from codelens import code_queries, run_queries
    from codelens.operators import detect

    counted, inner = {}, detect.materialise

    def counting(df, name):
        counted[name] = _exchanges(df)
        return inner(df, name)

    monkeypatch.setattr(detect, "materialise", counting)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert code_queries.QUERIES["scan_report"](spark, SMALL).count() > 0
        assert run_queries.QUERIES["patch_stages"](spark, SMALL).count() > 0
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert counted["findings"] <= 2 and counted["issues"] <= 2
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def _planned(spark, df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nested_results_are_parsed_once_a_level(spark):
    from codelens.operators.taxonomy import nested_taxonomy

    rows = [("a", '{"passed": false, "stage_results": {"compile": {"passed": false}, "c": {"passed": false, "stage_results": {"x": {"passed": false, "logs": ["test failed"]}}}}}')]
    out = nested_taxonomy(spark.createDataFrame(rows, "work_id string, validation string"))
    assert "from_json" not in _planned(spark, out)
    assert [(r.categories, r.failed_stages) for r in out.collect()] == [(["compile_failure", "test_failure"], ["compile", "c.x"])]


def test_hunks_meet_functions_by_name_and_bin_at_once(spark, monkeypatch):
    from codelens.operators import validate

    sides, inner = [], validate.overlapping
    monkeypatch.setattr(validate, "overlapping", lambda *a: sides.append(a[1]) or inner(*a))
    hunks = spark.createDataFrame([("p", "src/a.c", 1, 2, 1, 2)], "patch_id string, path string, old_start int, old_end int, new_start int, new_end int")
    functions = spark.createDataFrame([("/p/src/a.c", "f", 1, 9), ("/q/a.c", "g", 1, 9)], "path string, fn string, start_line int, end_line int")
    assert [(r.path, r.fn) for r in validate.touched_functions(hunks, functions).collect()] == [("/p/src/a.c", "f")]
    assert "Join" not in _planned(spark, sides[0])


def test_stages_stay_where_their_candidates_are(spark):
    from codelens import table_queries

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, most in (("stages_folded", 1), ("checker_ablation", 3)):
            assert _planned(spark, table_queries.QUERIES[name](spark, SMALL)).count("Exchange hashpartitioning") <= most, name
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scan_is_a_job_for_each_detector(spark, monkeypatch):
    from codelens import code_queries
    from codelens.operators import detect

    plans, inner = [], detect.materialise

    def planning(df, name):
        plans.append((name, _exchanges(df)))
        return inner(df, name)

    monkeypatch.setattr(detect, "materialise", planning)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert code_queries.QUERIES["scan_report"](spark, SMALL).count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = [p for p in plans if p[0] == "found"]
    assert len(found) == len(detect.DETECTORS) and all(exchanges == 0 for _, exchanges in found)
    assert {name for name, _ in plans} == {"functions", "found", "findings"}


def test_provenance_is_parsed_once(spark, monkeypatch):
    from codelens import code_queries
    from codelens.operators import lex

    parsed, inner = [], lex.functions
    monkeypatch.setattr(code_queries, "functions", lambda files: parsed.append(1) or inner(files))
    plan = _planned(spark, code_queries.QUERIES["scores_by_provenance"](spark, SMALL))
    assert parsed == [1] and "MapInArrow" not in plan and "Exchange" not in plan


def test_next_mark_is_found_from_the_end(spark):
    from codelens.operators.asof import next_after

    points = spark.createDataFrame([("a", 1), ("a", 1), ("a", 5), ("b", 2)], "k string, line int")
    marks = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("a", 7), ("b", 2)], "k string, line int")
    out = next_after(points, marks, ["k"], "line", "next")
    assert sorted((r.k, r.line, r.next) for r in out.where("k = 'a'").collect()) == [("a", 1, 5), ("a", 1, 5), ("a", 5, 7)]
    assert [r.next for r in out.where("k = 'b'").collect()] == [None]
    assert "unboundedfollowing" not in _planned(spark, out).lower()


def test_noted_lines_say_what_statements_say(spark):
    from pyspark.sql import functions as F

    from codelens.operators import lines

    texts = ["if (!p)", "goto out;", "out: free(p);", "case 1:", "p = (char *) malloc(n);", "x == f(y);", "return -1;", "a[i]->b = open(c);", "if (rc) close(fd);", "n++;", "", "std::free(q);"]
    plain = spark.createDataFrame([(t,) for t in texts], "stmt string")
    noted = lines.noted(plain)
    direct = plain.select("stmt", *[of(F.col("stmt")).alias(name) for name, of in lines.NOTES.items()])
    assert sorted(map(repr, noted.collect())) == sorted(map(repr, direct.collect()))
    assert {r.stmt for r in noted.where("says_goto = 'out'").collect()} == {"goto out;"} and {r.stmt for r in noted.where("says_label = 'out'").collect()} == {"out: free(p);"}
    assert {r.stmt for r in noted.where("says_assigned IS NOT NULL").collect()} == {"p = (char *) malloc(n);", "a[i]->b = open(c);"}
    assert {r.stmt for r in noted.where("says_cleanup IS NOT NULL").collect()} == {"out: free(p);", "if (rc) close(fd);", "std::free(q);"}
