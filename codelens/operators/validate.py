"""Two versions of a function table compared, fail-closed; diffs; failure categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import any_of, let, lookup
from .asof import next_after
from .detect import Tables, missing_cleanup_on_error, unchecked_return
from .facts import body_facts
from .intervals import overlapping
from .lines import FN, is_return

ISSUE = ["path", "fn", "issue"]


def resource_issues(t: Tables) -> DataFrame:
    """(path, fn, issue): acquisitions without release, early returns past locks and memory, and any two releases of one variable."""
    events = t.events.where("variable <> ''")
    acquired = events.where(F.col("kind").isin(*vocab.RELEASE_OF)).withColumn("wanted", lookup(F.col("kind"), vocab.RELEASE_OF))
    acquired = next_after(acquired, events.select(*FN, "variable", F.col("kind").alias("wanted"), "line"), [*FN, "variable", "wanted"], "line", "release")
    lacking = acquired.where("release IS NULL").select("path", "fn", F.concat("variable", F.lit(" acquired via "), "kind", F.lit(" at line "), F.col("line").cast("string"), F.lit(" lacks matching "), "wanted").alias("issue"))
    returns = t.lines.where(is_return(F.col("stmt")) | F.concat(F.lit(" "), "stmt", F.lit(" ")).contains(" return ")).withColumn("final", F.max("line").over(Window.partitionBy(*FN)))
    past = acquired.where(F.col("kind").isin("alloc", "lock")).select(*FN, "variable", F.col("line").alias("acquired"), "release").join(returns.select(*FN, "line", "stmt", "final"), FN)
    past = past.where("line > acquired AND (release IS NULL AND line <> final OR line < release)")
    early = past.select("path", "fn", F.concat(F.lit("early return at line "), F.col("line").cast("string"), F.lit(" may bypass cleanup of "), "variable", F.lit(" acquired at line "), F.col("acquired").cast("string"), F.lit(": "), "stmt").alias("issue"))
    twice = events.where(F.col("kind").isin(*vocab.RELEASE_OF.values())).groupBy(*FN, "variable", "kind").agg(F.array_sort(F.collect_list("line")).alias("at")).where("size(at) > 1")
    doubled = twice.select("path", "fn", F.concat(F.lit("obvious double "), "kind", F.lit(" of "), "variable", F.lit(" at lines "), F.array_join(F.transform("at", lambda x: x.cast("string")), ", ")).alias("issue"))
    return lacking.unionByName(early).unionByName(doubled)


def new_issues(before: DataFrame, after: DataFrame) -> DataFrame:
    """Issues after that no issue before equals; repeats stay."""
    return after.join(before.distinct(), ISSUE, "left_anti")


def semantic_issues(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, fn, issue): functions gone or new and public, changed public signatures, return forms and visible calls.

    Functions are the same if path and name are.
    """
    facts = lambda f: body_facts(f).select(
        "path", "fn", F.struct("signature", (~F.trim("signature").startswith("static ")).alias("public"), "returns", F.filter("calls", lambda c: F.element_at(F.split(c, "::"), -1).rlike("^(" + any_of(vocab.VISIBLE_CALLS) + ")$")).alias("visible")).alias("x")
    )
    both = facts(before).withColumnRenamed("x", "b").join(facts(after).withColumnRenamed("x", "a"), ["path", "fn"], "full_outer")
    same = F.col("a").isNotNull() & F.col("b").isNotNull()
    issues = F.array(
        F.when(F.col("a").isNull(), F.lit("function removed")),
        F.when(F.col("b").isNull() & F.col("a.public"), F.lit("new public function introduced")),
        F.when(same & F.col("b.public") & (F.col("a.signature") != F.col("b.signature")), F.lit("public signature changed")),
        F.when(same & (F.col("a.returns") != F.col("b.returns")), F.lit("return statement forms changed")),
        F.when(same & (F.col("a.visible") != F.col("b.visible")), F.lit("externally visible calls changed")),
    )
    return both.select("path", "fn", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


def _security_counts(t: Tables) -> DataFrame:
    body = F.col("body")
    calls = body_facts(t.functions).select(*FN, F.size(F.array_intersect("calls", F.array(*map(F.lit, vocab.UNSAFE_CALLS)))).alias("unsafe"), F.size(F.array_intersect("calls", F.array(*map(F.lit, vocab.SAFE_CALLS)))).alias("safe"))
    checks = t.functions.select(
        *FN,
        F.regexp_count(body, F.lit(r"\bif\s*\([^)]*(?:!\s*[A-Za-z_][A-Za-z_0-9]*|NULL|nullptr)\b[^)]*\)")).alias("null_checks"),
        F.regexp_count(body, F.lit(rf"(?i)\bif\s*\([^)]*(?:<=|>=|<|>)[^)]*(?:{any_of(vocab.BOUNDS_NAMES)})\b[^)]*\)")).alias("bounds_checks"),
    )
    releases = t.events.where(F.col("kind").isin(*vocab.RELEASE_OF.values())).groupBy(*FN).agg(F.count(F.lit(1)).alias("releases"))
    unchecked = unchecked_return(t).groupBy(*FN).agg(F.count(F.lit(1)).alias("unchecked_return_value"))
    missing = missing_cleanup_on_error(t).groupBy(*FN).agg(F.count(F.lit(1)).alias("missing_cleanup_on_error_path"))
    out = checks.join(calls, FN)
    for more in (releases, unchecked, missing):
        out = out.join(more, FN, "left")
    return out.na.fill(0).drop("ordinal")


def security_issues(before: Tables, after: Tables) -> DataFrame:
    """(path, fn, issue): fewer checks or releases, more unsafe calls or smells, in functions that both versions have."""
    b, a = _security_counts(before), _security_counts(after)
    names = [c for c in b.columns if c not in ("path", "fn")]
    both = b.select("path", "fn", *[F.col(c).alias(f"b_{c}") for c in names]).join(a, ["path", "fn"])
    fewer = lambda c: F.when(F.col(c) < F.col(f"b_{c}"), F.concat(F.lit(f"{c} decreased from "), F.col(f"b_{c}").cast("string"), F.lit(" to "), F.col(c).cast("string")))
    more = lambda c: F.when(F.col(c) > F.col(f"b_{c}"), F.concat(F.lit(f"{c} increased from "), F.col(f"b_{c}").cast("string"), F.lit(" to "), F.col(c).cast("string")))
    swapped = F.when((F.col("safe") < F.col("b_safe")) & (F.col("unsafe") > 0), F.lit("safe API usage appears to be replaced with unsafe API usage"))
    issues = F.array(fewer("null_checks"), fewer("bounds_checks"), F.when(F.col("unsafe") > F.col("b_unsafe"), F.lit("unsafe API usage increased")), swapped, more("unchecked_return_value"), more("missing_cleanup_on_error_path"), fewer("releases"))
    return both.select("path", "fn", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """(patch_id, path, old_start, old_end, new_start, new_end) of each hunk of unified diffs (patch_id, diff).

    A missing count is 1, and a count of 0 covers one line. The +++ line
    names the path, less a/ or b/ and leading dots and slashes; hunks of
    deleted files, and those before any path, are left out.
    """
    lines = diffs.select("patch_id", F.posexplode(F.split("diff", "\r?\n")).alias("at", "text"))
    raw = F.split(F.trim(F.substr("text", F.lit(5))), "\t")[0]
    path = F.regexp_replace(F.regexp_replace(F.replace(raw, F.lit("\\"), F.lit("/")), "^[./]+", ""), "^[ab]/", "")
    named = F.when(F.col("text").startswith("+++ "), F.when(raw == "/dev/null", F.lit("")).otherwise(path))
    order = Window.partitionBy("patch_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("path", F.last(named, ignorenulls=True).over(order)).where(F.col("text").rlike(HUNK) & (F.col("path") != ""))
    number = lambda k, missing: F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(text, '{HUNK}', {k}), '') as int)".replace("\\", "\\\\")), F.lit(missing))
    end = lambda s, n: number(s, 0) + F.greatest(number(n, 1), F.lit(1)) - 1
    return lines.select("patch_id", "path", number(1, 0).alias("old_start"), end(1, 2).alias("old_end"), number(3, 0).alias("new_start"), end(3, 4).alias("new_end"))


def _ends(paths: DataFrame, path: str, out: str) -> DataFrame:
    """``paths`` once for each end of ``path``, whole ones included, as ``out``."""
    return paths.withColumn(out, F.explode(F.transform(F.sequence(F.lit(1), F.length(path)), lambda i: F.substr(path, i))))


def touched_functions(hunks: DataFrame, functions: DataFrame, side: str = "new") -> DataFrame:
    """(patch_id, path, fn): functions that a hunk's lines overlap, in files one of whose paths ends with the other.

    The shorter path meets the ends of the longer ones in an equal join. The
    functions take the names that hunks have for their files, and hunks meet
    them by name and bin of lines at once: files of one name make no pair
    that isn't a match, and a name with most hunks is spread over its bins.
    """
    files = functions.select("path", F.regexp_replace("path", "^[./]+", "").alias("fp")).distinct().where("fp <> ''")
    named = hunks.select(F.col("path").alias("hp")).distinct().where("hp <> ''")
    longer, shorter = files.select("path", "fp"), named
    same = _ends(longer, "fp", "hp").join(shorter, "hp").select("path", "hp").unionByName(_ends(shorter, "hp", "fp").join(longer, "fp").select("path", "hp")).distinct()
    f = functions.select("path", "fn", "start_line", "end_line").join(same, "path")
    h = hunks.select("patch_id", F.col("path").alias("hp"), F.col(f"{side}_start").alias("s"), F.col(f"{side}_end").alias("e"))
    return overlapping(f, h, ["hp"], ("start_line", "end_line"), ("s", "e")).select("patch_id", "path", "fn").distinct()


def repaired_paths(paths: DataFrame, known: DataFrame) -> DataFrame:
    """``paths`` (path) with repaired: a known path, else the only known one that ends with it, else the only one of its name, else itself.

    Known paths are counted by each of their ends after a slash and by their
    names; a path then looks up one row of each.
    """
    k = known.select(F.col("path").alias("known")).where("known IS NOT NULL").distinct()
    exact = k.select(F.col("known").alias("path"), F.col("known").alias("exact"))
    parts = F.split("known", "/")
    ends = k.select("known", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("path")).where("path <> ''")
    by_end = ends.groupBy("path").agg(F.count(F.lit(1)).alias("n_end"), F.max("known").alias("end"))
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    by_name = k.groupBy(last("known").alias("__base")).agg(F.count(F.lit(1)).alias("n_name"), F.max("known").alias("name"))
    out = paths.join(exact, "path", "left").join(by_end, "path", "left").withColumn("__base", last("path")).join(by_name, "__base", "left")
    repaired = F.coalesce("exact", F.when(F.col("n_end") == 1, F.col("end")), F.when(F.col("n_name") == 1, F.col("name")), "path")
    return out.withColumn("repaired", repaired).drop("exact", "n_end", "end", "n_name", "name", "__base")


def stage_category(stage: Column, text: Column) -> Column:
    """The failure category of a failed stage, by its name; of applying a patch and of unknown stages by the text."""
    has = lambda low, *words: low.rlike(any_of(words))
    # the text is made, and read, only where it decides
    applied = let(F.lower(text), lambda low: (
        F.when(has(low, "empty patch"), "empty_patch").when(has(low, "no project changes"), "no_effect_patch").when(has(low, "path repair", "no such file", "does not exist"), "path_mismatch")
        .when(has(low, "patch failed", "hunk", "garbage", "apply"), "patch_does_not_apply").otherwise("unknown_validation_failure")
    ))
    other = let(F.lower(text), lambda low: (
        F.when(has(low, "insufficient_quota", "rate_limit"), "llm_rate_limit").when(has(low, "invalid_api_key", "llm request failed"), "llm_api_error")
        .when(has(low, "compile") & has(low, "failed"), "compile_failure").when(has(low, "test") & has(low, "failed"), "test_failure")
    ))
    return (
        F.when(stage.isin("restore_clean_project", "restore_after_validation"), "restore_failure").when(stage == "apply_patch", applied).when(stage == "compile", "compile_failure").when(stage == "tests", "test_failure")
        .when(stage == "static_analysis", "static_analysis_regression").when(stage == "resource_consistency", "resource_regression").when(stage == "semantic_equivalence", "semantic_regression")
        .when(stage == "security_regression", "security_regression").otherwise(other)
    )


def failure_taxonomy(stages: DataFrame) -> DataFrame:
    """(work_id, categories, counts, failed_stages, primary_category) of stage results (work_id, ordinal, stage, passed, text).

    Categories are sorted, so the primary one is the first by alphabet.
    """
    failed = stages.where(~F.coalesce("passed", F.lit(False))).withColumn("category", stage_category(F.col("stage"), F.col("text")))
    counts = failed.where("category IS NOT NULL").groupBy("work_id", "category").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("category", "n"))).alias("c"))
    names = failed.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "stage"))), lambda x: x["stage"]).alias("failed_stages"))
    out = names.join(counts, "work_id", "left")
    return out.select("work_id", F.coalesce(F.transform("c", lambda x: x["category"]), F.array().cast("array<string>")).alias("categories"), F.map_from_entries("c").alias("counts"), "failed_stages", F.col("c")[0]["category"].alias("primary_category"))
