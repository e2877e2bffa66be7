"""Lookups between findings, functions and results; folds of stages; predicates over reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import any_of
from .intervals import held, inside
from .lines import FN


def enclosing_function(points: DataFrame, functions: DataFrame) -> DataFrame:
    """``points`` (path, line) with enclosing: the function whose lines hold the place, of several the one that begins last."""
    spans = functions.select("path", F.col("fn").alias("__fn"), "start_line", "end_line")
    hit = held(points, spans, ["path"], "line").groupBy("path", "line").agg(F.max_by("__fn", F.struct("start_line", "__fn")).alias("enclosing"))
    return points.join(hit, ["path", "line"], "left")


def looked_up(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """``findings`` (path, fn, line) with found_path and found_fn: by path and name, else by name, else by place; of several the first by path and line."""
    names = functions.groupBy("path", "fn").agg(F.min("start_line").alias("at"))
    exact = names.select("path", "fn", F.struct("path", "fn").alias("exact"))
    by_name = functions.groupBy("fn").agg(F.min(F.struct("path", "start_line")).alias("m")).select("fn", F.struct(F.col("m.path").alias("path"), "fn").alias("named"))
    out = enclosing_function(findings.join(exact, ["path", "fn"], "left").join(by_name, "fn", "left"), functions)
    placed = F.when(F.col("enclosing").isNotNull(), F.struct("path", F.col("enclosing").alias("fn")))
    found = F.coalesce("exact", "named", placed)
    return out.withColumn("found_path", found["path"]).withColumn("found_fn", found["fn"]).drop("exact", "named", "enclosing")


def with_resource_evidence(findings: DataFrame, events: DataFrame, radius: int = 20) -> DataFrame:
    """``findings`` with near_resource: whether their function has a resource event within ``radius`` lines."""
    around = events.select(*FN, (F.col("line") - radius).alias("from"), (F.col("line") + radius).alias("to"))
    return inside(findings, around, FN, "line", "near_resource", "from", "to")


def with_reviews(batch: DataFrame, reviews: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """``batch`` with its reviews' columns; the defaults where there is no review or a value is missing."""
    return batch.join(reviews, key, "left").na.fill(defaults)


def numbered_candidates(candidates: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Candidates numbered from 1 within their opportunity."""
    return candidates.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def folded_stages(stages: DataFrame, key: str = "work_id") -> DataFrame:
    """(key, passed, failed, logs): whether all stages passed, which did not, and all logs, by the stages' order.

    A stage without a result counts as failed; an entry without a verdict of
    its own, such as a taxonomy, is no stage (see ``is_stage``).
    """
    own = stages.where(is_stage(F.col("stage")))
    ok = F.coalesce("passed", F.lit(False))
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "stage", ok.alias("ok"), F.coalesce("logs", F.array().cast("array<string>")).alias("logs"))))
    out = own.groupBy(key).agg(F.bool_and(ok).alias("passed"), rows.alias("r"))
    return out.select(key, "passed", F.transform(F.filter("r", lambda x: ~x["ok"]), lambda x: x["stage"]).alias("failed"), F.flatten(F.transform("r", lambda x: x["logs"])).alias("logs"))


def is_stage(name: Column) -> Column:
    return name != "failure_taxonomy"


def folded_candidates(candidates: DataFrame, key: str = "work_id") -> DataFrame:
    """(key, passed, messages): whether any candidate passed, and the failures of those that did not, each after its candidate's number."""
    ok = F.coalesce("passed", F.lit(False))
    prefix = F.concat(F.lit("candidate "), F.col("candidate").cast("string"), F.lit(": "))
    own = F.when(ok, F.array().cast("array<string>")).otherwise(F.transform(F.coalesce("logs", F.array().cast("array<string>")), lambda x: F.concat(prefix, x)))
    rows = F.array_sort(F.collect_list(F.struct("candidate", own.alias("m"))))
    return candidates.groupBy(key).agg(F.bool_or(ok).alias("passed"), F.flatten(F.transform(rows, lambda x: x["m"])).alias("messages"))


def failed_stages(results: DataFrame) -> DataFrame:
    """(work_id, stage) of nested results: stages by name, and those of candidates (stage holds a map of stages of its own) one level below."""
    top = results.select("work_id", F.explode("stages").alias("name", "s"))
    flat = top.where("s.stages IS NULL").select("work_id", F.col("name").alias("stage"), F.col("s.passed").alias("passed"))
    below = top.where("s.stages IS NOT NULL").select("work_id", F.explode("s.stages").alias("stage", "passed"))
    return flat.unionByName(below).where(~F.coalesce("passed", F.lit(False)) & is_stage(F.col("stage"))).select("work_id", "stage").distinct()


def is_unsafe_review(functional: Column, security: Column, resource: Column) -> Column:
    """Whether a review names a regression; only a plain true counts."""
    return F.coalesce(functional, F.lit(False)) | F.coalesce(security, F.lit(False)) | F.coalesce(resource, F.lit(False))


def is_false_accept(verdict: Column, unsafe: Column) -> Column:
    return F.coalesce(verdict.isin("incorrect", "likely_incorrect"), F.lit(False)) | F.coalesce(unsafe, F.lit(False))


def is_model_error(text: Column) -> Column:
    """Whether a log says that the model, not the patch, failed."""
    return F.coalesce(F.lower(text).rlike(any_of(["llm request failed", "insufficient_quota", "invalid_api_key", "rate_limit", "rate limit", "timed out while calling"])), F.lit(False))


def is_test_file(path: Column) -> Column:
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    return F.exists(F.split(low, "/"), lambda p: p.isin("test", "tests", "testing")) | name.rlike(r"^test_|_test\.|^test\.")


def failure_reason(text: Column) -> Column:
    """A category for failure logs, the first that fits."""
    low = F.lower(text)
    has = lambda *w: low.rlike(any_of(w))
    return (
        F.when(is_model_error(text), "model").when(has("patch does not apply", "patch failed", "hunk", "empty patch"), "apply").when(has("resource"), "resource").when(has("unsafe", "security"), "security")
        .when(has("signature", "return statement", "visible calls"), "API").when(has("compile"), "compile").when(has("test"), "test").otherwise("other")
    )
