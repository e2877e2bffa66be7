"""Findings after detection: enriched, deduplicated, clustered, weighed by place, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamped, deployment_contexts, evidence_label, gated, severity_named, severity_rank, verdict
from .intervals import inside


def enriched(findings: DataFrame) -> DataFrame:
    """With evidence, verdict, the severity that evidence carries, and id."""
    out = findings.withColumn("evidence", evidence_label(F.col("confidence"))).withColumn("verdict", verdict(F.col("confidence")))
    out = out.withColumn("severity", gated(F.col("impact"), F.col("evidence")))
    about = F.to_json(F.struct("confidence", "detail", "evidence", "expected", "impact", "pattern", "resource", "verdict"))
    return out.withColumn("id", F.concat_ws(":", "kind", "fn", F.col("line").cast("string"), F.substring(F.sha1(about.cast("binary")), 1, 10)))


def deduplicated(findings: DataFrame) -> DataFrame:
    """Of findings alike in function, kind, line and description the first by detector and place."""
    order = Window.partitionBy("path", "fn", "ordinal", "kind", "line", "description").orderBy("detector_rank", F.col("column").asc_nulls_first(), F.coalesce("resource", F.lit("")), F.coalesce("expected", F.lit("")), "id")
    return findings.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


CLUSTERED = ("resource_imbalance", "resource_early_return")


def clustered(findings: DataFrame) -> DataFrame:
    """Resource findings of one function, resource, pattern and counterpart become the worst of them, with cluster_size and cluster_ids.

    Sorted by severity, confidence and line. Others pass, with size 1.
    """
    joins = F.col("kind").isin(*CLUSTERED) & F.col("resource").isNotNull() & F.col("pattern").isNotNull()
    key = ["kind", "path", "fn", "ordinal", "resource", "pattern", "expected"]
    rest = [c for c in findings.columns if c not in key]
    rank = F.struct((-severity_rank(F.col("severity"))).alias("s"), (-F.col("confidence")).alias("c"), "line", "id")
    groups = findings.where(joins).groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("r"), F.count(F.lit(1)).cast("int").alias("cluster_size"), F.array_sort(F.collect_list(F.struct("line", "id"))).alias("all"))
    merged = groups.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest], "cluster_size", F.transform("all", lambda x: x["id"]).alias("cluster_ids"))
    more = F.concat("description", F.lit(" ("), F.col("cluster_size").cast("string"), F.lit(" related findings)"))
    merged = merged.withColumn("description", F.when(F.col("cluster_size") > 1, more).otherwise(F.col("description")))
    alone = findings.where(~F.coalesce(joins, F.lit(False))).withColumns({"cluster_size": F.lit(1), "cluster_ids": F.array("id")})
    return alone.unionByName(merged)


def weighed_by_path(findings: DataFrame) -> DataFrame:
    """Findings in tests, vendored and generated code count less, and their impact is capped; contexts says which."""
    contexts = deployment_contexts(F.col("path"))
    generated = F.array_contains("contexts", "generated_code")
    factor = F.when(generated, 0.65).when(F.array_contains("contexts", "vendored_or_external_path"), 0.75).otherwise(0.8)
    score = clamped(F.col("confidence") * factor)
    weighed = findings.withColumn("contexts", contexts).withColumn("__hit", F.size("contexts") > 0).withColumn("__score", score)
    weighed = weighed.withColumns({
        "evidence": F.when(F.col("__hit"), evidence_label(F.col("__score"))).otherwise(F.col("evidence")),
        "verdict": F.when(F.col("__hit"), verdict(F.col("__score"))).otherwise(F.col("verdict")),
        "impact": F.when(F.col("__hit"), severity_named(F.least(severity_rank(F.col("impact")), F.when(generated, 1).otherwise(2)))).otherwise(F.col("impact")),
        "confidence": F.when(F.col("__hit"), F.bround("__score", 3)).otherwise(F.col("confidence")),
    })
    return weighed.withColumn("severity", F.when(F.col("__hit"), gated(F.col("impact"), F.col("evidence"))).otherwise(F.col("severity"))).drop("__hit", "__score")


def worth_confirming() -> Column:
    """Severe findings, those of severe impact with high evidence, and those all but certain of medium impact at least."""
    impact = F.coalesce("impact", "severity")
    severe = impact.isin("critical", "high")
    return F.coalesce(F.col("severity").isin("critical", "high") | (severe & (F.col("evidence") == "high")) | ((F.col("confidence") >= 0.95) & (severe | (impact == "medium"))), F.lit(False))


def confirmed(findings: DataFrame, functions: DataFrame | None, all_of_them: bool = False) -> DataFrame:
    """``findings`` with confirmation, by the functions (path, start_line, end_line) that another parser finds.

    A finding worth confirming, or each with ``all_of_them``, is
    ``confirmed`` if any function of its file holds its line, and gets 1.05
    times its confidence, else ``unconfirmed`` at 0.75 times; evidence,
    verdict and severity follow from the score before it is rounded. Others
    are ``skipped`` and stay as they are, so do all that would have been
    tried where there is no other parser (``functions`` None): ``unavailable``.
    """
    tried = F.lit(True) if all_of_them else worth_confirming()
    if functions is None:
        return findings.withColumn("confirmation", F.when(tried, "unavailable").otherwise("skipped"))
    rows = inside(findings, functions, ["path"], "line", "__seen").withColumn("confirmation", F.when(~tried, "skipped").when(F.col("__seen"), "confirmed").otherwise("unconfirmed"))
    score = clamped(F.coalesce("confidence", F.lit(0.5)) * F.when(F.col("confirmation") == "confirmed", 1.05).otherwise(0.75))
    changed = F.col("confirmation") != "skipped"
    rows = rows.withColumn("__score", F.when(changed, score)).withColumns({
        "evidence": F.when(changed, evidence_label(F.col("__score"))).otherwise(F.col("evidence")),
        "verdict": F.when(changed, verdict(F.col("__score"))).otherwise(F.col("verdict")),
        "confidence": F.when(changed, F.bround("__score", 3)).otherwise(F.col("confidence")),
    })
    return rows.withColumn("severity", F.when(changed, gated(F.coalesce("impact", "severity"), F.col("evidence"))).otherwise(F.col("severity"))).drop("__seen", "__score")


def ranking() -> list:
    """By severity and confidence, then place and kind; description and id settle what is left."""
    return [severity_rank(F.col("severity")).desc(), F.desc("confidence"), F.asc("path"), F.asc("line"), F.asc("kind"), F.asc("description"), F.asc("id")]


def ranked(findings: DataFrame, most: int | None = None) -> DataFrame:
    """Sorted; the first ``most`` if given (0: none)."""
    out = findings.orderBy(*ranking())
    return out if most is None else out.limit(most)


def numbered(findings: DataFrame) -> DataFrame:
    """With report_index: place in the ranking of the whole report, from 1.

    Findings are counted by rank, confidence and path first; so rows are
    sorted within one file's findings of one confidence, and the counts
    before them are added.
    """
    rows = findings.withColumn("__rank", severity_rank(F.col("severity")))
    keys = ["__rank", "confidence", "path"]
    files = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    levels = files.groupBy("__rank", "confidence").agg(F.sum("__n").alias("__all"))
    above = Window.orderBy(F.desc("__rank"), F.desc("confidence")).rowsBetween(Window.unboundedPreceding, -1)  # a few thousand rows at most: confidences have 3 places
    levels = levels.select(F.col("__rank").alias("__r"), F.col("confidence").alias("__c"), F.coalesce(F.sum("__all").over(above), F.lit(0)).alias("__above"))
    earlier = Window.partitionBy("__rank", "confidence").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    files = files.join(levels, F.col("__rank").eqNullSafe(F.col("__r")) & F.col("confidence").eqNullSafe(F.col("__c")))
    files = files.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], (F.col("__before") + F.col("__above")).alias("__offset"))
    same = F.col("__rank").eqNullSafe(F.col("__k0")) & F.col("confidence").eqNullSafe(F.col("__k1")) & F.col("path").eqNullSafe(F.col("__k2"))
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*ranking()))).join(files, same)
    return rows.withColumn("report_index", (F.col("__place") + F.col("__offset")).cast("long")).drop("__rank", "__place", "__offset", "__k0", "__k1", "__k2")
