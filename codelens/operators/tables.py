"""Relational operators over findings, queues, results and reviews."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import rate


def counts_by(rows: DataFrame, group: Sequence[str], what: str) -> DataFrame:
    """(group..., what, n)."""
    return rows.groupBy(*group, what).agg(F.count(F.lit(1)).alias("n"))


def totals(rows: DataFrame, group: str, sums: Sequence[str]) -> DataFrame:
    """Sums by group, and over all with a null group, to 3 places."""
    return rows.rollup(group).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 3).alias(c) for c in sums])


def severity_columns(rows: DataFrame, group: str, severity: str = "severity") -> DataFrame:
    """A column for each severity, 0 where there is none."""
    names = vocab.SEVERITIES[1:]
    return rows.groupBy(group).pivot(severity, names).agg(F.count(F.lit(1))).na.fill(0, names)


def progress(queue: DataFrame, results: DataFrame, group: str) -> DataFrame:
    """(group, queued, processed, passed, pending) over a queue and its results (work_id, passed)."""
    q = queue.select(F.col(group), F.lit(1).alias("queued"), F.lit(0).alias("processed"), F.lit(0).alias("passed"))
    r = results.select(F.col(group), F.lit(0).alias("queued"), F.lit(1).alias("processed"), F.coalesce("passed", F.lit(False)).cast("int").alias("passed"))
    out = q.unionByName(r).groupBy(group).agg(*[F.sum(c).alias(c) for c in ("queued", "processed", "passed")])
    return out.withColumn("pending", F.greatest(F.lit(0), F.col("queued") - F.col("processed")))


def evidence_at_least(label: Column, least: str) -> Column:
    """Whether an evidence label reaches another; unknown ones don't."""
    return F.array_position(F.array(*map(F.lit, vocab.EVIDENCE)), label) >= vocab.EVIDENCE.index(least) + 1


def build_queue(findings: DataFrame, project: str, severities: Sequence[str], order: list[Column], per_project: int | None = None, most: int | None = None, projects: Sequence[str] | None = None, least_evidence: str | None = None) -> DataFrame:
    """Findings of some severities, numbered in the whole report of their project, up to a number for each and in all, in project order.

    work_id is project:%06d:id with that number.
    """
    whole = Window.partitionBy(project).orderBy(*order)
    rows = findings.where(F.col(project).isin(list(projects))) if projects else findings
    rows = rows.withColumn("report_index", F.row_number().over(whole)).where(F.lower("severity").isin(list(severities)))
    if least_evidence:
        rows = rows.where(F.coalesce(evidence_at_least(F.col("evidence"), least_evidence), F.lit(False)))
    if per_project is not None:
        rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy(project).orderBy("report_index"))).where(F.col("__k") <= per_project).drop("__k")
    rows = rows.withColumn("work_id", F.format_string("%s:%06d:%s", F.col(project).cast("string"), "report_index", F.col("id").cast("string")))
    return rows if most is None else rows.orderBy(project, "report_index").limit(most)


def pending(queue: DataFrame, done: DataFrame, key: str = "work_id") -> DataFrame:
    return queue.join(done.select(key).distinct(), key, "left_anti")


def start_after(queue: DataFrame, order: Sequence[str], at: tuple) -> DataFrame:
    """Rows that follow ``at`` in the order."""
    here = F.struct(*[F.lit(x).cast(queue.schema[c].dataType).alias(c) for c, x in zip(order, at, strict=True)])
    return queue.where(F.struct(*order) > here)


def last_written(results: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Of rows with one key the last by order; rows without a key stay."""
    rest = F.struct(*[F.col(c) for c in results.columns if c != key])
    keyed = results.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(rest, F.struct(*order)).alias("r")).select(key, "r.*")
    return keyed.select(*results.columns).unionByName(results.where(F.col(key).isNull()))


def first_written(results: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    rest = F.struct(*[F.col(c) for c in results.columns if c != key])
    return results.groupBy(key).agg(F.min_by(rest, F.struct(*order)).alias("r")).select(key, "r.*").select(*results.columns)


def ordered_merge(queue: DataFrame, results: DataFrame, key: str = "work_id", place: str = "place") -> DataFrame:
    """Results with sort_key: the queue's places first, then results of no queue row by key."""
    where = results.join(queue.select(key, F.col(place).alias("__p")), key, "left")
    return where.withColumn("in_queue", F.col("__p").isNotNull()).withColumn("sort_key", F.when(F.col("__p").isNotNull(), F.format_string("0:%012d", "__p")).otherwise(F.concat(F.lit("1:"), F.col(key).cast("string")))).drop("__p")


def assign_shards(sizes: DataFrame, workers: int, key: str = "project", size: str = "n") -> DataFrame:
    """(key, size, worker): largest first to the worker with the least, ties to the lowest number.

    Each choice needs the loads that the one before left, so one task goes
    through the sizes, a row for a project and none for its items, in order.
    """
    ordered = sizes.select(key, F.col(size).cast("long").alias(size)).orderBy(F.desc(size), F.asc(key)).coalesce(1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = [(0, k) for k in range(workers)]
        for b in batches:
            chosen = []
            for n in b[size]:
                load, k = heapq.heappop(loads)
                heapq.heappush(loads, (load + int(n), k))
                chosen.append(k)
            yield b.assign(worker=chosen)

    return ordered.mapInPandas(assign, f"`{key}` {sizes.schema[key].dataType.simpleString()}, `{size}` long, worker int")


def compare_systems(candidates: DataFrame, system: str = "system") -> DataFrame:
    """(system, generated, applicable, passed, regressions and their rates) of candidates (applied, passed, regression)."""
    true = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    out = candidates.groupBy(system).agg(F.count(F.lit(1)).alias("generated"), true("applied").alias("applicable"), true("passed").alias("passed"), true("regression").alias("regressions"))
    return out.withColumns({"apply_rate": rate(F.col("applicable"), F.col("generated")), "pass_rate": rate(F.col("passed"), F.col("generated")), "regression_rate": rate(F.col("regressions"), F.col("generated"))})


def ablation(stages: DataFrame, reviews: DataFrame, key: str = "candidate_key") -> DataFrame:
    """A row for each set of disabled checkers: what passes without them, what that adds to the full validator, and how much of it reviews reject.

    stages: (key, stage, passed); reviews: (key, false_accept). The five sets
    are expanded within one aggregation of the candidates, so stages are read
    and shuffled once.
    """
    failed = stages.groupBy(key).agg(F.collect_set(F.when(~F.coalesce("passed", F.lit(False)), F.col("stage"))).alias("failed"))
    variants = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(name).alias("variant"), F.array(*map(F.lit, off)).cast("array<string>").alias("off")) for k, (name, off) in enumerate(vocab.VARIANTS)])
    each = failed.join(reviews, key, "left").select(key, "failed", "false_accept", F.explode(variants).alias("v")).select(key, "failed", "false_accept", "v.*")
    passes = F.size(F.array_except("failed", "off")) == 0
    extra = passes & (F.size("failed") > 0)
    out = each.groupBy("place", "variant").agg(
        F.count(F.lit(1)).alias("generated"), F.count_if(passes).alias("passed"), F.count_if(extra).alias("extra"),
        F.count_if(extra & F.col("false_accept").isNotNull()).alias("reviewed"), F.count_if(extra & F.coalesce("false_accept", F.lit(False))).alias("false_accepted"),
    )
    return out.withColumns({"pass_rate": rate(F.col("passed"), F.col("generated")), "extra_rate": rate(F.col("extra"), F.col("passed")), "false_accept_rate": rate(F.col("false_accepted"), F.col("reviewed"))}).drop("place")


def verdict_table(systems: DataFrame, reviews: DataFrame, strict: str, lenient: Sequence[str]) -> DataFrame:
    """(system, reviewed, strict, lenient and rates), also for systems without reviews."""
    out = systems.join(reviews, "system", "left").groupBy("system").agg(F.count("verdict").alias("reviewed"), F.count_if(F.col("verdict") == strict).alias("strict"), F.count_if(F.col("verdict").isin(list(lenient))).alias("lenient"))
    return out.withColumns({"strict_rate": rate(F.col("strict"), F.col("reviewed")), "lenient_rate": rate(F.col("lenient"), F.col("reviewed"))})


def nearest_rank(rows: DataFrame, group: Sequence[str], value: str, q: float, out: str, parts: int = 4096) -> DataFrame:
    """The value at place round((n - 1) * q) from 0, half to even, to 3 decimals.

    Equal values are counted first. Each group's range is cut into ``parts``
    equal stretches, whose counts tell in which one the place lies; only
    that stretch's values are sorted, so no task sorts a whole group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ends = counts.groupBy(*group).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.sum("__n").alias("__all"))
    share = (F.col("__v") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0))
    placed = counts.join(ends, list(group)).withColumn("__part", F.least(F.lit(parts - 1), F.floor(F.coalesce(share, F.lit(0)) * parts)))
    want = F.bround((F.col("__all") - 1) * F.lit(q), 0)
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = placed.groupBy(*group, "__part").agg(F.sum("__n").alias("__k"), F.first("__all").alias("__all")).withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0)))
    stretch = stretches.where((want >= F.col("__before")) & (want < F.col("__before") + F.col("__k"))).select(*group, "__part", "__before")
    upto = Window.partitionBy(*group).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.join(stretch, [*group, "__part"]).withColumn("__upto", F.col("__before") + F.sum("__n").over(upto))
    return inside.where(F.col("__upto") > want).groupBy(*group).agg(F.bround(F.min("__v"), 3).alias(out))


def phase_cost(rows: DataFrame, phase: str, project: str, seconds: str) -> DataFrame:
    """(phase, projects, items, total, mean, median, p95) of durations."""
    out = rows.groupBy(phase).agg(
        F.countDistinct(project).alias("projects"), F.count(F.lit(1)).alias("items"), F.round(F.sum(seconds), 3).alias("total"), F.round(F.avg(seconds), 3).alias("mean"), F.round(F.percentile(seconds, F.lit(0.5)), 3).alias("median")
    )
    return out.join(nearest_rank(rows, [phase], seconds, 0.95, "p95"), phase)


def opposite_outcomes(a: DataFrame, b: DataFrame, key: str = "work_id") -> DataFrame:
    """Work that a passed and b did not."""
    return a.where("passed").select(key).join(b.where(~F.coalesce("passed", F.lit(False))).select(key), key, "left_semi")


def least_by(rows: DataFrame, group: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """A row of each group with the least value; of an empty input none."""
    order = Window.partitionBy(*group).orderBy(value, *ties)
    return rows.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def seeded_sample(rows: DataFrame, n: int, seed: int, key: str = "work_id") -> DataFrame:
    """n rows by the order of a hash of key and seed, sorted by key."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n).orderBy(key)


def last_results(rows: DataFrame, order: Sequence[str], n: int = 25) -> DataFrame:
    """The last n rows, in order."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def zipped_candidates(results: DataFrame, patches: str, validations: str) -> DataFrame:
    """A row for each candidate of a result, its patch and validation by place, null where one list is shorter."""
    return results.select("*", F.posexplode(F.arrays_zip(F.col(patches).alias("patch"), F.col(validations).alias("validation"))).alias("candidate", "z")).select("*", "z.*").drop("z", patches, validations)
