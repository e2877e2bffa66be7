"""Runs and their records: claims on a queue, summaries with count maps, reviews, comparison of runs, trees."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import any_of, rate, rule_key, safe_name


def completed(*results: DataFrame, key: str = "work_id") -> DataFrame:
    """The keys that any of the result tables (the run's own and its workers') has, each once."""
    out = results[0].select(key)
    for r in results[1:]:
        out = out.union(r.select(key))
    return out.where(F.col(key).isNotNull()).distinct()


def claimable(queue: DataFrame, done: DataFrame, claims: DataFrame, now: Column, stale_seconds: float, key: str = "work_id") -> DataFrame:
    """Rows of the queue that are neither done nor held by a claim (key, reserved_at in seconds) that isn't stale.

    With ``stale_seconds`` 0 or less no claim grows stale. A claim without a
    time is as old as can be.
    """
    age = now.cast("double") - F.coalesce(F.col("reserved_at").cast("double"), F.lit(0.0))
    held = claims.where(age <= stale_seconds) if stale_seconds > 0 else claims
    return queue.join(done.select(key).distinct(), key, "left_anti").join(held.select(key).distinct(), key, "left_anti")


def claim_file(work_id: Column) -> Column:
    """The name under which a claim on a work item is kept."""
    return F.concat(F.substring(safe_name(work_id), 1, 120), F.lit("-"), F.substring(F.sha2(work_id, 256), 1, 16), F.lit(".lock"))


def next_claims(free: DataFrame, workers: int, order: Sequence[str], key: str = "work_id") -> DataFrame:
    """(worker, key): the first free items, one for each worker from 0."""
    first = free.orderBy(*order).limit(workers).select(key, *[c for c in order if c != key])
    return first.withColumn("worker", F.row_number().over(Window.orderBy(*order)) - 1).select("worker", key)


def run_summary(queue: DataFrame, results: DataFrame) -> DataFrame:
    """(what, name, n): a run's numbers and its eight maps of counts, a row for each entry.

    queue: (work_id, severity, kind); results: (work_id, project, status,
    severity, kind, selected, passed, failed_stages, categories). Numbers
    have an empty name.
    """
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    one = lambda rows, what, n: rows.agg(n.cast("long").alias("n")).select(F.lit(what).alias("what"), F.lit("").alias("name"), "n")
    by = lambda rows, what, name: rows.groupBy(name.cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), F.coalesce("name", F.lit("None")).alias("name"), "n")
    count = F.count(F.lit(1))
    queued, seen = one(queue, "queue_size", count), one(results, "seen", F.countDistinct("work_id"))
    pending = queued.select("n").join(seen.select(F.col("n").alias("seen"))).select(F.lit("pending").alias("what"), F.lit("").alias("name"), F.greatest(F.lit(0), F.col("n") - F.col("seen")).alias("n"))
    project = F.coalesce("project", F.lit("unknown"))
    parts = [
        queued, one(results, "processed", count), pending, one(results, "selected_patches", F.count_if(true("selected"))), one(results, "validation_passed", F.count_if(true("passed"))),
        by(results, "status_counts", F.col("status")), by(queue, "queue_severity_counts", F.col("severity")), by(queue, "queue_kind_counts", F.col("kind")),
        by(results, "processed_severity_counts", F.col("severity")), by(results, "processed_kind_counts", F.col("kind")),
        by(results.select(F.explode("failed_stages").alias("x")), "failed_stage_counts", F.col("x")), by(results.select(F.explode("categories").alias("x")), "failure_category_counts", F.col("x")),
        by(results, "projects_processed", project), by(results.where(true("passed")), "projects_passed", project),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def failure_columns(systems: DataFrame, reviews: DataFrame) -> DataFrame:
    """(system, failed_patches, a column for each failure category), also for systems without reviews; others and missing ones are unclear only if null."""
    known = reviews.select("system", F.coalesce("failure_category", F.lit("unclear")).alias("c"))
    counts = [F.count_if(F.col("c") == c).alias(c) for c in vocab.FAILURE_CATEGORIES]
    return systems.select("system").distinct().join(known, "system", "left").groupBy("system").agg(F.count("c").alias("failed_patches"), *counts)


def detector_precision(reviews: DataFrame) -> DataFrame:
    """One row over reviews (label, security_relevant, resource_relevant): counts by label, strict and lenient precision, share of false positives."""
    label = lambda x: F.count_if(F.col("label") == x).alias(x)
    true = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    out = reviews.agg(F.count(F.lit(1)).alias("reviewed"), *map(label, ("true_positive", "likely_true_positive", "false_positive", "unclear")), true("security_relevant"), true("resource_relevant"))
    of = lambda c: rate(c, F.col("reviewed"))
    return out.withColumns({"strict_precision": of(F.col("true_positive")), "lenient_precision": of(F.col("true_positive") + F.col("likely_true_positive")), "false_positive_rate": of(F.col("false_positive"))})


def is_regression(failed: Column, counterexamples: Column) -> Column:
    """Whether a result's failed stages, or the words of its counterexamples, say that a patch made things worse."""
    by_stage = F.arrays_overlap(F.coalesce(failed, F.array().cast("array<string>")), F.array(*map(F.lit, vocab.CHECKERS)))
    by_word = F.lower(F.array_join(F.coalesce(counterexamples, F.array().cast("array<string>")), "\n")).rlike(any_of(vocab.REGRESSION_MARKERS))
    return F.coalesce(by_stage, F.lit(False)) | by_word


def run_numbers(queue: DataFrame, results: DataFrame) -> DataFrame:
    """One row of a run: queue_size, processed, generated, applicable, passed, unsafe_regressions, and rates in percent.

    results: (candidates, applied, passed, failed_stages, counterexamples).
    """
    true = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    own = results.agg(
        F.count(F.lit(1)).alias("processed"), F.coalesce(F.sum("candidates"), F.lit(0)).cast("long").alias("generated"), true("applied").alias("applicable"), true("passed").alias("passed"),
        F.count_if(is_regression(F.col("failed_stages"), F.col("counterexamples"))).alias("unsafe_regressions"),
    )
    percent = lambda a: F.when(F.col("processed") > 0, F.round(100.0 * F.col(a) / F.col("processed"), 2)).otherwise(F.lit(0.0))
    return queue.agg(F.count(F.lit(1)).alias("queue_size")).join(own).withColumns({"apply_rate": percent("applicable"), "pass_rate": percent("passed")})


def run_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two rows of ``run_numbers``."""
    names = ["queue_size", "processed", "generated", "applicable", "passed", "unsafe_regressions", "apply_rate", "pass_rate"]
    long = lambda rows, c: rows.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(n).cast("double") for n in names]))).alias("metric", c))
    return long(before, "before").join(long(after, "after"), "metric").withColumn("delta", F.round(F.col("after") - F.col("before"), 2))


def stage_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(stage, before, after, delta): failed stages (stage) of two runs, also those of one run only."""
    counts = lambda rows, c: rows.groupBy("stage").agg(F.count(F.lit(1)).alias(c))
    out = counts(before, "before").join(counts(after, "after"), "stage", "full_outer").na.fill(0, ["before", "after"])
    return out.withColumn("delta", F.col("after") - F.col("before"))


def head_of(values: Column, most: int) -> Column:
    """The first values of a list, of a null one none."""
    return F.coalesce(F.slice(values, 1, most), F.array().cast("array<string>"))


def compact_json(value: Column, most: int, mark: str = "...[truncated]") -> Column:
    """A struct, map or array as JSON without spaces, cut to ``most`` characters with the mark behind."""
    text = F.to_json(value)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def rule_family(kind: Column) -> Column:
    """The family of refinement rules for a kind or pattern, by its normalised key."""
    key = rule_key(kind)
    named = F.create_map(*[F.lit(x) for kv in (vocab.RULE_ALIASES | {f: f for f in vocab.RULE_FAMILIES}).items() for x in kv])
    return F.coalesce(F.try_element_at(named, key), F.lit("general"))


def all_sources(*sources: DataFrame) -> DataFrame:
    """(path, language) of source tables, each path once: the last table's row counts."""
    ranked = None
    for k, s in enumerate(sources):
        rows = s.select("path", "language", F.lit(k).alias("k"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    return ranked.groupBy("path").agg(F.max_by("language", F.struct("k", "language")).alias("language"))


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, diff): a unified diff for each file that two trees (path, content) don't have alike; a file that one lacks is empty there."""
    both = before.select("path", F.col("content").alias("b")).join(after.select("path", F.col("content").alias("a")), "path", "full_outer").where("NOT (a <=> b)")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            diffs = ["\n".join(difflib.unified_diff((b or "").splitlines(), (a or "").splitlines(), f"a/{p}", f"b/{p}", lineterm="")) for p, b, a in zip(x["path"], x["b"], x["a"], strict=True)]
            yield pd.DataFrame({"path": x["path"], "diff": diffs})

    return both.mapInPandas(made, "path string, diff string").where("diff <> ''")
