"""Places in stretches of lines, confirmation, paths by their ends and nested taxonomies against plain versions, with hot files and names."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from codelens.operators import detect, findings, intervals, review, validate
from codelens.operators.taxonomy import nested_taxonomy

SPANS = "path string, fn string, start_line int, end_line int"


def _spans(seed, n=120, files=4):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        a = rnd.randrange(900)
        out.append((f"m{rnd.randrange(files)}.c", f"f{k}", a, a + rnd.choice([-1, 0, 3, 40, 200])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_places_meet_the_spans_that_hold_them(spark, seed):
    spans, rnd = _spans(seed), random.Random(seed + 50)
    places = [(f"m{rnd.randrange(5)}.c", rnd.randrange(1100)) for _ in range(300)]
    s, p = spark.createDataFrame(spans, SPANS), spark.createDataFrame(places, "path string, line int")
    got = [(r.path, r.line, r.fn) for r in intervals.held(p, s, ["path"], "line").collect()]
    want = {(path, line, fn) for path, line in places for other, fn, a, b in spans if path == other and a <= line <= b}
    assert len(got) == len(want) and set(got) == want
    inner = {r: max(((a, fn) for other, fn, a, b in spans if r[0] == other and a <= r[1] <= b), default=(0, None))[1] for r in places}
    assert {(r.path, r.line): r.enclosing for r in review.enclosing_function(p, s).collect()} == inner
    seen = intervals.inside(p, s, ["path"], "line", "seen").collect()
    assert len(seen) == 300 and all(r.seen == (inner[r.path, r.line] is not None) for r in seen)
    pairs = intervals.overlapping(s, s.select("path", F.col("fn").alias("g"), F.col("start_line").alias("a"), F.col("end_line").alias("b")), ["path"], ("start_line", "end_line"), ("a", "b"))
    real = [x for x in spans if x[2] <= x[3]]
    assert sorted((r.fn, r.g) for r in pairs.collect()) == sorted((x[1], y[1]) for x in real for y in real if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])


def test_a_file_with_most_places_is_spread(spark):
    lines = spark.range(200_000).select(F.lit("hot.c").alias("path"), F.col("id").cast("int").alias("line"))
    spans = spark.range(2_000).select(F.lit("hot.c").alias("path"), F.concat(F.lit("f"), "id").alias("fn"), (F.col("id") * 100).cast("int").alias("start_line"), (F.col("id") * 100 + 60).cast("int").alias("end_line"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = intervals.held(lines, spans, ["path"], "line")
        assert found.count() == 2_000 * 61
        tasks = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in tasks) < 0.06 * 2_000 * 61
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def _finding(spark, *rows):
    return spark.createDataFrame(rows, "id string, path string, line int, severity string, impact string, confidence double, evidence string, verdict string")


def test_confirmation_by_any_function_of_the_file(spark):
    spans = spark.createDataFrame([("a.c", "other", 5, 10)], SPANS)
    rows = _finding(
        spark,
        ("in", "a.c", 7, "high", "critical", 0.78, "medium", "likely"), ("out", "a.c", 11, "high", "critical", 0.78, "medium", "likely"), ("file", "b.c", 7, "critical", "critical", 0.9, "high", "true_positive"),
        ("low", "a.c", 7, "low", "medium", 0.94, "high", "true_positive"), ("sure", "a.c", 7, "medium", "medium", 0.95, "high", "true_positive"), ("severe", "a.c", 7, "medium", None, 0.7, "medium", "likely"), ("gated", "a.c", 7, "medium", "high", 0.8, "high", "likely"),
    )
    got = {r.id: (r.confirmation, r.confidence, r.evidence, r.verdict, r.severity) for r in findings.confirmed(rows, spans).collect()}
    assert got["in"] == ("confirmed", 0.819, "high", "likely", "critical")
    assert got["out"] == ("unconfirmed", 0.585, "medium", "unclear", "high")
    assert got["file"] == ("unconfirmed", 0.675, "medium", "likely", "high")
    assert got["low"] == ("skipped", 0.94, "high", "true_positive", "low") and got["severe"][0] == "skipped"
    assert got["sure"][:2] == ("confirmed", round(0.95 * 1.05, 3)) and got["gated"] == ("confirmed", 0.84, "high", "likely", "high")
    assert {r.confirmation for r in findings.confirmed(rows, spans, all_of_them=True).collect()} == {"confirmed", "unconfirmed"}
    assert {r.confirmation for r in findings.confirmed(rows, None).collect()} == {"skipped", "unavailable"}


def test_near_events_by_bins(spark):
    fn = "path string, fn string, ordinal int, line int"
    rows = [("a", "f", 0, n) for n in range(0, 400, 7)] + [("a", "g", 0, 3)]
    events = [("a", "f", 0, 60), ("a", "f", 0, 300), ("a", "h", 0, 3)]
    got = review.with_resource_evidence(spark.createDataFrame(rows, fn), spark.createDataFrame(events, fn))
    assert {(r.fn, r.line): r.near_resource for r in got.collect()} == {(f, n): any(f == g and abs(n - at) <= 20 for _, g, _, at in events) for _, f, _, n in rows}


def test_paths_meet_by_their_ends_only(spark):
    hunks = [(1, "src/main.c", 1, 5), (2, "main.c", 90, 95), (3, "deep/tree/src/main.c", 3, 3), (4, "n.c", 1, 2)]
    files = [("/root/src/main.c", "f", 4, 9), ("/root/lib/main.c", "g", 80, 91), ("src/main.c", "h", 3, 4), ("domain.c", "k", 1, 200), ("./tree/src/main.c", "m", 3, 3), ("other.c", "n", 1, 9)]
    h = spark.createDataFrame(hunks, "patch_id int, path string, new_start int, new_end int")
    got = {(r.patch_id, r.path, r.fn) for r in validate.touched_functions(h, spark.createDataFrame(files, SPANS)).collect()}
    clean = lambda p: p.lstrip("./")
    assert got == {(i, p, fn) for i, hp, a, b in hunks for p, fn, s, e in files if (clean(p).endswith(hp) or hp.endswith(clean(p))) and s <= b and e >= a}


def test_one_name_in_many_folders_makes_few_pairs(spark):
    files = spark.range(20_000).select(F.concat(F.lit("d"), F.col("id"), F.lit("/main.c")).alias("path"), F.lit("f").alias("fn"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    hunks = spark.range(2_000).select(F.col("id").alias("patch_id"), F.concat(F.lit("x/d"), F.col("id"), F.lit("/main.c")).alias("path"), F.lit(2).alias("new_start"), F.lit(3).alias("new_end"))
    assert validate.touched_functions(hunks, files).count() == 2_000
    paths = spark.createDataFrame([("d7/main.c",), ("main.c",), ("9/main.c",), ("q/other.c",), ("",)], "path string")
    got = {r.path: r.repaired for r in validate.repaired_paths(paths, files.union(spark.createDataFrame([("a/d7/main.c", "f", 1, 2), ("z/other.c", "f", 1, 2)], SPANS))).collect()}
    assert got == {"d7/main.c": "d7/main.c", "main.c": "main.c", "9/main.c": "9/main.c", "q/other.c": "z/other.c", "": ""}


def _stage(**more):
    return {"passed": False, **more}


def test_taxonomy_of_nested_results(spark):
    deep = _stage(stage_results={"compile": _stage(), "apply_patch": _stage(logs=["Hunk 1 FAILED"])}, logs=["candidate failed"])
    rows = {
        "nested": _stage(stage_results={"candidate_0": _stage(stage_results={"apply_patch": _stage(logs=["git apply --check failed"], counterexamples=["patch does not apply"])}, logs=["candidate failed"])}),
        "missing": None, "broken": "{", "passed": {"passed": True, "stage_results": {"compile": _stage()}},
        "twice": _stage(stage_results={"tests": _stage(), "a": deep, "b": deep, "compile": {"passed": True}, "note": "x", "failure_taxonomy": {}}),
        "known": _stage(stage_results={"failure_taxonomy": {"categories": ["b", "a"], "category_counts": {"a": 3}, "failed_stages": ["q"], "primary_category": "b"}}),
        "inner": _stage(stage_results={"c": _stage(stage_results={"failure_taxonomy": {"categories": ["z"], "failed_stages": ["q"]}, "compile": _stage()})}),
        "text": _stage(logs=["the compile", "has failed"]), "silent": _stage(logs=["nothing"]), "unknown": _stage(stage_results={"odd": _stage(warnings="hm")}),
    }
    made = [(k, v if v is None or v == "{" else json.dumps(v)) for k, v in rows.items()]
    got = {r.work_id: (r.categories, r.counts, r.failed_stages, r.primary_category) for r in nested_taxonomy(spark.createDataFrame([*made, made[0]], "work_id string, validation string")).collect()}
    assert got["nested"] == (["patch_does_not_apply"], {"patch_does_not_apply": 1}, ["candidate_0.apply_patch"], "patch_does_not_apply")
    assert got["missing"] == (["missing_validation"], {"missing_validation": 1}, [], "missing_validation") == got["broken"]
    assert got["passed"] == ([], {}, [], None) == got["silent"]
    assert got["twice"] == (["compile_failure", "patch_does_not_apply", "test_failure"], {"compile_failure": 2, "patch_does_not_apply": 2, "test_failure": 1}, ["tests", "a.compile", "a.apply_patch", "b.compile", "b.apply_patch"], "compile_failure")
    assert got["known"] == (["b", "a"], {"a": 3}, ["q"], "b") and got["inner"][0] == ["z"] and got["inner"][2] == ["c.q"]
    assert got["text"][0] == ["compile_failure"] and got["text"][2] == []
    assert got["unknown"] == (["unknown_validation_failure"], {"unknown_validation_failure": 1}, ["odd"], "unknown_validation_failure")
    assert len(got) == len(rows)
    assert nested_taxonomy(spark.createDataFrame([], "work_id string, validation string")).count() == 0


def test_names_in_texts_by_their_words(spark):
    rnd = random.Random(8)
    parts = ["p", "buf", "p2", "ctx->buf", "->", ".", " ", ",", "(", ")", "&", "*", "[0]", "x", "_", "a[i]", "ctx"]
    texts = [("a.c", rnd.choice("fg"), 0, n, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))) for n in range(400)]
    names = [("a.c", fn, 0, k) for fn in "fg" for k in ("p", "buf", "ctx->buf", "a[i]", "(x)", "a", "ctx", "[0]", "x._", "")]
    got = detect.mentioned(spark.createDataFrame(texts, "path string, fn string, ordinal int, line int, text string"), spark.createDataFrame(names, "path string, fn string, ordinal int, key string"))
    found = [(r.fn, r.key, r.line) for r in got.collect()]
    want = {(fn, k, n) for _, fn, _, n, text in texts for _, g, _, k in names if fn == g and re.search(r"\w", k) and re.search(r"(^|\W)" + re.escape(k) + r"($|\W)", text)}
    assert len(found) == len(set(found)) and set(found) == want


def test_resets_and_returns_by_what_ends_before_the_sign(spark):
    fn = ("a.c", "f", 0)
    stmts = ["p = NULL;", "xp = malloc(9);", "ctx->buf=0;", "a[0] = NULL;", "p == NULL", "q = p;", "int *p=nullptr, r = make(1);", "b[0]=0", "if (p = open(x)) return q ;", "return p;", "return  ctx->buf ;", "returns p;", "x = 0; return a[0];"]
    lines = spark.createDataFrame([(*fn, n, s, s) for n, s in enumerate(stmts)], "path string, fn string, ordinal int, line int, raw string, stmt string")
    keys = ["p", "ctx->buf", "a[0]", "q", "r"]
    events = spark.createDataFrame([(*fn, 0, "alloc", k, "malloc", "") for k in keys], "path string, fn string, ordinal int, line int, kind string, variable string, call string, raw string")
    t = detect.Tables(lines, lines, events)
    value = r"=(NULL|nullptr|0|[A-Za-z_]\w*\()"
    tail = lambda k: (re.search(r"[A-Za-z_]\w*$", k) or [k])[0]
    want = {(k, n) for n, s in enumerate(stmts) for k in keys if re.search(re.escape(tail(k)) + value, re.sub(r"\s+", "", s))}
    assert {(r.key, r.line) for r in detect.resets(t).collect()} == want and ("a[0]", 3) in want and ("a[0]", 7) not in want
    back = {(k, n) for n, s in enumerate(stmts) for k in keys if re.search(r"\breturn\s+" + re.escape(k) + r"\s*;", s)}
    assert {(r.key, r.line) for r in detect.consumed(t).collect()} == back
