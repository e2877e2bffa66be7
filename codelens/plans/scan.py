"""A whole scan, and the validation of a patched tree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, findings, graph, validate
from ..operators.lex import functions
from ..sources.corpus import read_sources


@dataclass
class Scan:
    """From files to ranked findings, which lie in the shared folder when ``findings`` returns (not if it is given tables).

    ``extra`` detectors take Tables and return rows of detect.FINDING.
    ``confirm`` is a function table of another parser, against which
    findings worth it are checked (see ``findings.confirmed``).
    """

    files: DataFrame
    most: int | None = None
    detectors: list[str] | None = None
    extra: dict[str, Callable[[detect.Tables], DataFrame]] = field(default_factory=dict)
    confirm: DataFrame | None = None

    @classmethod
    def of(cls, spark: SparkSession, root: str, **options: object) -> Scan:
        return cls(read_sources(spark, root), **options)

    def tables(self) -> detect.Tables:
        """Functions, code lines and events, parsed once, laid out by function and cached until they are released."""
        return detect.Tables.of(functions(self.files)).keep()

    def findings(self, tables: detect.Tables | None = None) -> DataFrame:
        t = tables or self.tables()
        more = [d(t).withColumn("detector_rank", F.lit(len(detect.DETECTORS) + k)) for k, d in enumerate(self.extra.values())]
        found = detect.found(t, self.detectors, more) if tables is None else reduce(DataFrame.unionByName, more, detect.detect(t, self.detectors))
        out = findings.weighed_by_path(findings.clustered(findings.deduplicated(findings.enriched(found))))
        if self.confirm is not None:
            out = findings.confirmed(out, self.confirm)
        summaries = graph.summaries(t.functions, t.events).select("path", "fn", "ordinal", "summary")
        out = out.join(summaries, ["path", "fn", "ordinal"], "left")
        return findings.ranked(t.finish(out, "findings") if tables is None else out, self.most)


def validated(before: DataFrame, after: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    """(stage, passed, issues) of the three checkers over two versions of files (path, content).

    With ``diffs``, resource issues count only in functions that a hunk
    touches; if none is touched, in all.
    """
    tb, ta = detect.Tables.of(functions(before)).written(), detect.Tables.of(functions(after)).written()
    b, a = tb.functions, ta.functions
    new = validate.new_issues(validate.resource_issues(tb), validate.resource_issues(ta))
    if diffs is not None:
        touched = validate.touched_functions(validate.diff_hunks(diffs), a).select("path", "fn").distinct()
        any_touched = touched.agg((F.count(F.lit(1)) > 0).alias("any"))
        marked = new.join(touched.withColumn("hit", F.lit(True)), ["path", "fn"], "left").join(F.broadcast(any_touched))
        new = marked.where("hit OR NOT any").select("path", "fn", "issue")
    stages = [("resource_consistency", new), ("semantic_equivalence", validate.semantic_issues(b, a)), ("security_regression", validate.security_issues(tb, ta))]
    out = None
    for k, (name, issues) in enumerate(stages):
        row = issues.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.concat_ws(": ", "path", "fn", "issue"))).alias("issues")).select(F.lit(k).alias("ordinal"), F.lit(name).alias("stage"), (F.col("n") == 0).alias("passed"), "issues")
        out = row if out is None else out.unionByName(row)
    return out
