"""The report of a run: a row for each opportunity with its plan, patches and validation, and its forms as JSON, Markdown and .diff files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counterexamples, or else logs, that a failure's reason names.
REASONS = 3
#: Changed lines up to which a patch counts as small.
SMALL = 8


def diff_summary(diff: Column) -> Column:
    """(files, added, removed) of a unified diff."""
    lines = F.split(diff, "\n")
    named = F.transform(F.filter(lines, lambda x: x.startswith("+++ ")), lambda x: F.regexp_replace(F.regexp_replace(F.split(F.substr(x, F.lit(5)), "\t")[0], "^[./]+", ""), "^[ab]/", ""))
    count = lambda mark, head: F.size(F.filter(lines, lambda x: x.startswith(mark) & ~x.startswith(head)))
    return F.struct(F.array_distinct(F.filter(named, lambda x: x != "/dev/null")).alias("files"), count("+", "+++").alias("added"), count("-", "---").alias("removed"))


def failure_reason(counterexamples: Column, logs: Column) -> Column:
    """The first counterexamples of a validation, or else logs, in one text."""
    first = lambda a: F.array_join(F.slice(a, 1, REASONS), "; ")
    return F.when(F.size(counterexamples) > 0, first(counterexamples)).when(F.size(logs) > 0, first(logs)).otherwise("validation failed")


def patch_records(opportunities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (opportunity_id, candidate_id, place, selected, diff, explanation) with candidate_number, the paths of their files and what their diffs change.

    opportunities: (opportunity_id, number). Patches of unknown opportunities
    come under the number after the last.
    """
    last = opportunities.agg(F.coalesce(F.max("number"), F.lit(0)).alias("last"))
    rows = candidates.join(opportunities.select("opportunity_id", "number"), "opportunity_id", "left").join(F.broadcast(last))
    rows = rows.withColumn("number", F.coalesce("number", F.col("last") + 1).cast("int")).drop("last")
    rows = rows.withColumn("candidate_number", F.row_number().over(Window.partitionBy("opportunity_id").orderBy("place")))
    chosen = F.coalesce("selected", F.lit(False))
    return rows.withColumns({
        "selected": chosen, "candidate_path": F.format_string("patches/opportunity-%03d-candidate-%03d.diff", "number", "candidate_number"),
        "selected_path": F.when(chosen, F.format_string("patches/opportunity-%03d-selected.diff", "number")), "change": diff_summary(F.col("diff")),
    })


def security_impact(kind: Column, failed: Column, reason: Column, safe_to_remove: Column, constraint: Column) -> Column:
    return (
        F.when(failed, F.concat(F.lit("Open: the patch did not pass ("), reason, F.lit(")."))).when(kind.contains("resource"), "Resources should be released more safely, in the same order.")
        .when((kind == "duplicate_check") & safe_to_remove, "A repeated check may go; evidence that this is safe is kept.").when(kind == "duplicate_check", "It isn't shown that the repeated check may go; checks should stay as they are.")
        .when(kind == "security_smell", "Sensitive code should be easier to review, with no check weakened.").when(constraint.isNotNull(), F.concat(F.lit("Kept: "), constraint)).otherwise("None known; invariants are kept.")
    )


def performance_estimate(strategy: Column, changed: Column) -> Column:
    """changed: the selected patch's added and removed lines, null without one."""
    helper = F.lower(F.coalesce(strategy, F.lit(""))).rlike("helper|abstraction")
    return F.when(changed.isNull(), "Unknown: no patch was selected.").when(helper, "Low to moderate: a helper adds a call and saves repetition.").when(changed <= SMALL, "Negligible: the change is small and local.").otherwise("Low: nothing costly is added.")


def report(opportunities: DataFrame, plans: DataFrame, records: DataFrame, validations: DataFrame) -> DataFrame:
    """A row for each opportunity: number, explanation, before and after, failures, impacts and traceability.

    opportunities: (opportunity_id, number, kind, description, safe_to_remove);
    plans: (opportunity_id, intent, strategy, constraint); records: see
    ``patch_records``; validations: (opportunity_id, passed, counterexamples,
    logs). All but the first may lack rows.
    """
    item = F.struct("candidate_number", "candidate_id", "selected", "candidate_path", "selected_path", "explanation", "change")
    own = records.groupBy("opportunity_id").agg(F.array_sort(F.collect_list(item)).alias("patches"))
    planned = plans.select("opportunity_id", "intent", "strategy", "constraint", F.lit(True).alias("planned"))
    checked = validations.select("opportunity_id", "passed", failure_reason(F.col("counterexamples"), F.col("logs")).alias("reason"), F.lit(True).alias("checked"))
    rows = opportunities.join(planned, "opportunity_id", "left").join(checked, "opportunity_id", "left").join(own, "opportunity_id", "left")
    rows = rows.withColumn("patches", F.coalesce("patches", F.array().cast(records.select(F.array(item).alias("x")).schema["x"].dataType)))
    rows = rows.withColumns({"selected": F.filter("patches", lambda p: p["selected"]), "failed": F.coalesce(F.col("checked") & ~F.coalesce("passed", F.lit(False)), F.lit(False))})
    rows = rows.withColumn("best", F.try_element_at("selected", F.lit(1)))
    changed = F.col("best.change.added") + F.col("best.change.removed")
    lost = F.when(~F.col("failed"), F.array().cast("array<string>")).when(F.size("patches") == 0, F.array(F.lit(None).cast("string"))).otherwise(
        F.transform(F.when(F.exists("patches", lambda p: ~p["selected"]), F.filter("patches", lambda p: ~p["selected"])).otherwise(F.slice("patches", -1, 1)), lambda p: p["candidate_id"])
    )
    said = F.when(F.col("best").isNull(), "No patch selected.").otherwise(F.coalesce(F.nullif(F.col("best.explanation"), F.lit("")), F.lit("Selected patch.")))
    return rows.select(
        "number", "opportunity_id", "kind", F.concat_ws(" ", F.coalesce("intent", "description"), said).alias("explanation"),
        F.coalesce(F.col("best.change.files"), F.array().cast("array<string>")).alias("files_changed"), F.coalesce("best.change.added", F.lit(0)).alias("lines_added"), F.coalesce("best.change.removed", F.lit(0)).alias("lines_removed"),
        "passed", lost.alias("failed_candidates"), F.when(F.col("failed"), F.col("reason")).alias("failure_reason"),
        security_impact(F.col("kind"), F.col("failed"), F.col("reason"), F.coalesce("safe_to_remove", F.lit(False)), F.col("constraint")).alias("security_impact"),
        performance_estimate(F.when(F.col("planned"), F.col("strategy")), changed).alias("performance"),
        F.transform("patches", lambda p: p["candidate_id"]).alias("candidate_ids"), F.transform("selected", lambda p: p["selected_path"]).alias("selected_paths"),
    )


def summary(opportunities: DataFrame, plans: DataFrame, records: DataFrame, validations: DataFrame) -> DataFrame:
    """One row: how many opportunities, plans, patches, selected ones, validations and failed ones."""
    count = F.count(F.lit(1))
    out = opportunities.agg(count.alias("opportunities")).join(plans.agg(count.alias("plans")))
    out = out.join(records.agg(count.alias("candidates"), F.count_if("selected").alias("selected")))
    return out.join(validations.agg(count.alias("validations"), F.count_if(~F.coalesce("passed", F.lit(False))).alias("failed_validations")))


def markdown_lines(rows: DataFrame) -> DataFrame:
    """(number, text): a Markdown section for each row of the report."""
    listed = lambda c: F.when(F.size(c) == 0, "none").otherwise(F.array_join(c, ", "))
    text = F.concat_ws(
        "\n", F.format_string("## %d. %s", "number", "kind"), F.lit(""), F.col("explanation"), F.lit(""), F.format_string("- changes: %s (+%d, -%d)", listed("files_changed"), "lines_added", "lines_removed"),
        F.concat(F.lit("- validation: "), F.when(F.col("passed").isNull(), "not run").when(F.col("passed"), "passed").otherwise(F.concat(F.lit("failed: "), F.col("failure_reason")))),
        F.concat(F.lit("- security: "), F.col("security_impact")), F.concat(F.lit("- performance: "), F.col("performance")), F.concat(F.lit("- patches: "), listed("candidate_ids")), F.lit(""),
    )
    return rows.select("number", text.alias("text"))


def write_report(rows: DataFrame, records: DataFrame, folder: str) -> None:
    """Writes the report as JSON lines and Markdown, by number, and each diff as a text file below a folder of its path's name."""
    rows.orderBy("number").write.mode("overwrite").json(f"{folder}/report.json")
    markdown_lines(rows).orderBy("number").select("text").write.mode("overwrite").text(f"{folder}/report.md")
    each = records.select(F.col("candidate_path").alias("file"), "diff").unionByName(records.where("selected").select(F.col("selected_path").alias("file"), "diff"))
    each.write.mode("overwrite").partitionBy("file").text(f"{folder}/patches")


def console(rows: DataFrame, project: str) -> DataFrame:
    """(number, text): a line for the run, and one for each opportunity."""
    head = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("number"), F.concat(F.lit(f"{project}: "), F.col("n").cast("string"), F.lit(" opportunities")).alias("text"))
    return head.unionByName(rows.select("number", F.concat(F.lit("- ["), "kind", F.lit("] "), "explanation").alias("text")))
