"""Queries of the relational operators over the driver's tables, and the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .functions import scalars as S
from .operators import findings, graph, review, tables, validate
from .operators.taxonomy import nested_taxonomy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, of: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: of(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    if sql:
        SQL[name] = sql


#: Orders as findings: priorities are severities, the customer's nation is the project.
SEVERITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END"


def _findings(read: Callable[[str], DataFrame]) -> DataFrame:
    joined = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("o_orderkey").alias("id"), F.col("n_name").alias("project"), F.expr(SEVERITY).alias("severity"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("seconds"))


FINDINGS = f"f AS (SELECT o_orderkey AS id, n_name AS project, {SEVERITY} AS severity, o_orderstatus AS status, o_totalprice AS seconds FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"

#: Line items as candidates: flags are outcomes of the stages.
STAGES = "struct('resource_consistency' AS stage, l_tax < 0.06D AS passed), struct('semantic_equivalence' AS stage, l_discount < 0.08D AS passed), struct('security_regression' AS stage, l_quantity < 45D AS passed), struct('compile' AS stage, l_returnflag <> 'R' AS passed)"


def _candidates(read: Callable[[str], DataFrame]) -> DataFrame:
    """A candidate for each part and supplier: the least of its line items' values."""
    lines = read("lineitem").groupBy("l_partkey", "l_suppkey").agg(*[F.min(c).alias(c) for c in ("l_tax", "l_discount", "l_quantity", "l_returnflag", "l_linestatus", "l_extendedprice")])
    return lines.withColumn("candidate_key", F.concat_ws("::", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))


def _by_key(read: Callable[[str], DataFrame]) -> DataFrame:
    """The same, laid out by candidate_key: what groups or joins them by it, or their stages, needs no exchange of its own."""
    key = F.concat_ws("::", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return read("lineitem").groupBy(key.alias("candidate_key")).agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_tax", "l_discount", "l_quantity", "l_returnflag", "l_linestatus", "l_extendedprice")])


CANDIDATES = "c AS (SELECT l_partkey || '::' || l_suppkey AS candidate_key, l_partkey, l_suppkey, min(l_tax) AS l_tax, min(l_discount) AS l_discount, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_partkey, l_suppkey)"
_STAGES_SQL = "s AS (SELECT candidate_key, unnest(['resource_consistency', 'semantic_equivalence', 'security_regression', 'compile']) AS stage, unnest([l_tax < 0.06, l_discount < 0.08, l_quantity < 45, l_returnflag <> 'R']) AS passed FROM c)"


def _stages(read: Callable[[str], DataFrame]) -> DataFrame:
    return _by_key(read).select("candidate_key", F.explode(F.expr(f"array({STAGES})")).alias("s")).select("candidate_key", "s.*")


def _rate(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN round({a}::DOUBLE / {b}::DOUBLE, 6) ELSE 0.0::DOUBLE END"


_query("severity_counts", lambda r: tables.counts_by(_findings(r), ["project"], "severity"), f"WITH {FINDINGS} SELECT project, severity, count(*) AS n FROM f GROUP BY ALL")
_query("corpus_totals", lambda r: tables.totals(_findings(r), "project", ["seconds"]), f"WITH {FINDINGS} SELECT project, count(*) AS n, round(sum(seconds), 3) AS seconds FROM f GROUP BY ROLLUP (project)")
_query("severity_columns", lambda r: tables.severity_columns(_findings(r), "project"), f"WITH {FINDINGS} SELECT project, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in vocab.SEVERITIES[1:]) + " FROM f GROUP BY project")
_query(
    "run_progress",
    lambda r: tables.progress(_findings(r), _findings(r).where("status <> 'P' AND id % 3 <> 0").select("project", (F.col("status") == "F").alias("passed")), "project"),
    f"WITH {FINDINGS} SELECT project, count(*) AS queued, count(*) FILTER (WHERE status <> 'P' AND id % 3 <> 0) AS processed, count(*) FILTER (WHERE status = 'F' AND id % 3 <> 0) AS passed, greatest(0, count(*) - count(*) FILTER (WHERE status <> 'P' AND id % 3 <> 0)) AS pending FROM f GROUP BY project",
)
_query(
    "work_queue",
    lambda r: tables.build_queue(_findings(r), "project", ["critical", "high"], [S.severity_rank(F.col("severity")).desc(), F.desc("seconds"), F.asc("id")], per_project=40, most=600).select("work_id", "project", "report_index", "severity", "id"),
    f"""WITH {FINDINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, seconds DESC, id) AS report_index FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY report_index) AS k FROM n WHERE severity IN ('critical', 'high'))
SELECT project || ':' || lpad(report_index::VARCHAR, 6, '0') || ':' || id AS work_id, project, report_index::INTEGER AS report_index, severity, id FROM k WHERE k <= 40 ORDER BY project, report_index LIMIT 600""",
)
_query("pending_work", lambda r: tables.pending(_findings(r), _findings(r).where("id % 4 = 0"), "id").select("id", "project"), f"WITH {FINDINGS} SELECT id, project FROM f WHERE id NOT IN (SELECT id FROM f WHERE id % 4 = 0)")
_query("start_after", lambda r: tables.start_after(_findings(r), ["project", "id"], ("FRANCE", 5000)).select("id", "project"), f"WITH {FINDINGS} SELECT id, project FROM f WHERE (project, id) > ('FRANCE', 5000)")
_query(
    "last_written_results",
    lambda r: tables.last_written(r("events").select(F.col("user_id").alias("work_id"), "event_id", "ts", "event_type", "value"), "work_id", ["ts", "event_id"]).select("work_id", "event_id", "event_type", "value"),
    "SELECT user_id AS work_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
_query(
    "first_written_results",
    lambda r: tables.first_written(r("events").select(F.col("user_id").alias("work_id"), "event_id", "ts", "event_type"), "work_id", ["ts", "event_id"]).select("work_id", "event_id", "event_type"),
    "SELECT user_id AS work_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
)
_query(
    "ordered_merge",
    lambda r: tables.ordered_merge(r("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("work_id"), (F.col("c_custkey") * 7 % 1000).alias("place")), r("orders").select(F.col("o_custkey").alias("work_id"), F.col("o_orderkey").alias("result"))).select("work_id", "result", "in_queue", "sort_key"),
    "SELECT o_custkey AS work_id, o_orderkey AS result, c_custkey IS NOT NULL AS in_queue, CASE WHEN c_custkey IS NOT NULL THEN '0:' || lpad((c_custkey * 7 % 1000)::VARCHAR, 12, '0') ELSE '1:' || o_custkey END AS sort_key FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey",
)
_query(
    "shard_assignment",
    lambda r: tables.assign_shards(_findings(r).groupBy("project").agg(F.count(F.lit(1)).alias("n")), 4),
    f"""WITH RECURSIVE {FINDINGS}, z AS (SELECT project, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, project) AS i FROM f GROUP BY project),
step(i, project, n, worker, loads) AS (SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, -1, [0::BIGINT, 0, 0, 0] UNION ALL
  SELECT z.i, z.project, z.n, (list_position(s.loads, list_min(s.loads)) - 1)::INTEGER, [CASE WHEN j = list_position(s.loads, list_min(s.loads)) THEN s.loads[j] + z.n ELSE s.loads[j] END FOR j IN [1, 2, 3, 4]] FROM step s JOIN z ON z.i = s.i + 1)
SELECT project, n, worker FROM step WHERE i > 0""",
)
_query(
    "system_comparison",
    lambda r: tables.compare_systems(r("lineitem").select(F.col("l_returnflag").alias("system"), (F.col("l_tax") < 0.04).alias("applied"), ((F.col("l_tax") < 0.04) & (F.col("l_discount") < 0.03)).alias("passed"), (F.col("l_linestatus") == "O").alias("regression"))),
    f"""SELECT *, {_rate("applicable", "generated")} AS apply_rate, {_rate("passed", "generated")} AS pass_rate, {_rate("regressions", "generated")} AS regression_rate FROM (
SELECT l_returnflag AS system, count(*) AS generated, count(*) FILTER (WHERE l_tax < 0.04) AS applicable, count(*) FILTER (WHERE l_tax < 0.04 AND l_discount < 0.03) AS passed, count(*) FILTER (WHERE l_linestatus = 'O') AS regressions FROM lineitem GROUP BY l_returnflag)""",
)
_query(
    "checker_ablation",
    lambda r: tables.ablation(_stages(r), _by_key(r).where("l_suppkey % 2 = 0").select("candidate_key", (F.col("l_linestatus") == "O").alias("false_accept"))),
    f"""WITH {CANDIDATES}, {_STAGES_SQL}, v AS (SELECT * FROM (VALUES ('Full validator', []::VARCHAR[]), ('No resource checker', ['resource_consistency']), ('No semantic checker', ['semantic_equivalence']), ('No security checker', ['security_regression']),
  ('No resource/semantic/security checkers', ['resource_consistency', 'semantic_equivalence', 'security_regression'])) v(variant, off)),
b AS (SELECT variant, candidate_key, bool_and(passed OR list_contains(off, stage)) AS ok, bool_and(passed) AS full_ok FROM s CROSS JOIN v GROUP BY ALL),
r AS (SELECT variant, count(*) AS generated, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE ok AND NOT full_ok) AS extra, count(*) FILTER (WHERE ok AND NOT full_ok AND l_suppkey % 2 = 0) AS reviewed,
  count(*) FILTER (WHERE ok AND NOT full_ok AND l_suppkey % 2 = 0 AND l_linestatus = 'O') AS false_accepted FROM b JOIN c USING (candidate_key) GROUP BY variant)
SELECT *, {_rate("passed", "generated")} AS pass_rate, {_rate("extra", "passed")} AS extra_rate, {_rate("false_accepted", "reviewed")} AS false_accept_rate FROM r""",
)
_query(
    "review_verdicts",
    lambda r: tables.verdict_table(r("region").select(F.col("r_name").alias("system")), _findings(r).join(F.broadcast(r("nation")), F.col("project") == F.col("n_name")).join(F.broadcast(r("region")), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'ASIA'").select(F.col("r_name").alias("system"), F.col("status").alias("verdict")), "F", ["F", "O"]),
    f"""SELECT *, {_rate("strict", "reviewed")} AS strict_rate, {_rate("lenient", "reviewed")} AS lenient_rate FROM (SELECT r_name AS system, count(v.status) AS reviewed, count(*) FILTER (WHERE status = 'F') AS strict, count(*) FILTER (WHERE status IN ('F', 'O')) AS lenient
FROM region LEFT JOIN (SELECT n_regionkey, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA') v ON v.n_regionkey = r_regionkey GROUP BY r_name)""",
)
_query(
    "failure_pivot",
    lambda r: _stages(r).where("NOT passed").groupBy("stage").agg(F.count(F.lit(1)).alias("failed"), F.countDistinct("candidate_key").alias("candidates")),
    f"WITH {CANDIDATES}, {_STAGES_SQL} SELECT stage, count(*) AS failed, count(DISTINCT candidate_key) AS candidates FROM s WHERE NOT passed GROUP BY stage",
)
_query(
    "failure_taxonomy",
    lambda r: validate.failure_taxonomy(_stages(r).select(F.col("candidate_key").alias("work_id"), F.expr("array_position(array('resource_consistency', 'semantic_equivalence', 'security_regression', 'compile'), stage)").alias("ordinal"), "stage", "passed", F.lit("").alias("text"))).select("work_id", F.array_join("categories", ",").alias("categories"), F.array_join("failed_stages", ",").alias("failed_stages"), "primary_category"),
    f"""WITH {CANDIDATES}, {_STAGES_SQL}, k AS (SELECT candidate_key, stage, list_position(['resource_consistency', 'semantic_equivalence', 'security_regression', 'compile'], stage) AS i,
  CASE stage WHEN 'resource_consistency' THEN 'resource_regression' WHEN 'semantic_equivalence' THEN 'semantic_regression' WHEN 'compile' THEN 'compile_failure' ELSE stage END AS category FROM s WHERE NOT passed)
SELECT candidate_key AS work_id, string_agg(category, ',' ORDER BY category) AS categories, string_agg(stage, ',' ORDER BY i) AS failed_stages, min(category) AS primary_category FROM k GROUP BY candidate_key""",
)
_query(
    "phase_cost",
    lambda r: tables.phase_cost(_findings(r), "status", "project", "seconds"),
    f"""WITH {FINDINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY seconds) - 1 AS k, count(*) OVER (PARTITION BY status) AS n FROM f)
SELECT status, count(DISTINCT project) AS projects, count(*) AS items, round(sum(seconds), 3) AS total, round(avg(seconds), 3) AS mean, round(quantile_cont(seconds, 0.5), 3) AS median, round_even(max(seconds) FILTER (WHERE k = round_even((n - 1) * 0.95, 0)), 3) AS p95 FROM n GROUP BY status""",
)
_query(
    "opposite_outcomes",
    lambda r: tables.opposite_outcomes(*[_candidates(r).select(F.col("candidate_key").alias("work_id"), F.expr(p).alias("passed")) for p in ("l_tax < 0.02D", "l_discount < 0.02D")]),
    f"WITH {CANDIDATES} SELECT candidate_key AS work_id FROM c WHERE l_tax < 0.02 AND NOT l_discount < 0.02",
)
_query(
    "smallest_change",
    lambda r: tables.least_by(_candidates(r), ["l_partkey"], "l_quantity", ["l_suppkey"]).select("l_partkey", "l_suppkey", "l_quantity"),
    f"WITH {CANDIDATES} SELECT l_partkey, l_suppkey, l_quantity FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity, l_suppkey) = 1",
)
_query("last_results", lambda r: tables.last_results(r("events").select("event_id", "ts", "event_type"), ["ts", "event_id"]).select("event_id", "event_type"), "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
_query("seeded_sample", lambda r: tables.seeded_sample(r("orders").select(F.col("o_orderkey").alias("work_id"), "o_orderpriority"), 100, 7), None)
_query(
    "severity_gate",
    lambda r: r("part").select("p_partkey", (F.col("p_size") / 50.0).alias("score"), F.expr("CASE WHEN p_size % 3 = 0 THEN 'critical' WHEN p_size % 3 = 1 THEN 'high' ELSE 'odd' END").alias("impact")).select("p_partkey", S.evidence_label(F.col("score")).alias("evidence"), S.verdict(F.col("score")).alias("verdict"), S.gated(F.col("impact"), S.evidence_label(F.col("score"))).alias("severity")),
    """WITH s AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS score, CASE p_size % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END AS impact FROM part),
e AS (SELECT *, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS evidence FROM s)
SELECT p_partkey, evidence, CASE WHEN score >= 0.85 THEN 'true_positive' WHEN score >= 0.65 THEN 'likely' WHEN score >= 0.45 THEN 'unclear' ELSE 'false_positive' END AS verdict,
  ['info', 'low', 'medium', 'high', 'critical'][least(impact, CASE evidence WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END) + 1] AS severity FROM e""",
)
_query(
    "call_resolution",
    lambda r: graph.resolved_calls(r("customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat('ns', c_nationkey, '::', c_mktsegment) WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE concat('x::', c_name) END").alias("call")), r("customer").select(F.expr("concat('ns', c_nationkey % 5, '::', c_mktsegment)").alias("name"))).select("c_custkey", "call", "dst"),
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ns' || c_nationkey || '::' || c_mktsegment WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'x::' || c_name END AS call FROM customer),
k AS (SELECT DISTINCT 'ns' || c_nationkey % 5 || '::' || c_mktsegment AS name, c_mktsegment AS short FROM customer), s AS (SELECT short, min(name) AS name FROM k GROUP BY short)
SELECT c_custkey, call, coalesce((SELECT k.name FROM k WHERE k.name = call), (SELECT s.name FROM s WHERE s.short = regexp_extract(call, '[^:]*$')), call) AS dst FROM c""",
)


def _diffs(read: Callable[[str], DataFrame]) -> DataFrame:
    """A diff for each order, a hunk for each of its line items."""
    hunk = F.format_string("@@ -%d,%d +%d @@", F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_suppkey") + 1)
    lines = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_suppkey", "l_linenumber", hunk.alias("h")))).alias("hs"))
    path = F.concat(F.lit("--- a/src/m"), (F.col("l_orderkey") % 7).cast("string"), F.lit(".c\n+++ b/src/m"), (F.col("l_orderkey") % 7).cast("string"), F.lit(".c\n"))
    return lines.select(F.col("l_orderkey").alias("patch_id"), F.concat(path, F.array_join(F.transform("hs", lambda x: x["h"]), "\n x\n")).alias("diff"))


def _suppliers(read: Callable[[str], DataFrame]) -> DataFrame:
    """A function of six lines for each supplier."""
    return read("supplier").select(F.expr("concat('/p/src/m', s_suppkey % 7, '.c')").alias("path"), F.col("s_name").alias("fn"), F.col("s_suppkey").cast("int").alias("start_line"), (F.col("s_suppkey") + 5).cast("int").alias("end_line"))


_HUNKS = "h AS (SELECT l_orderkey AS patch_id, 'src/m' || l_orderkey % 7 || '.c' AS path, l_suppkey::INTEGER AS old_start, (l_suppkey + l_linenumber - 1)::INTEGER AS old_end, (l_suppkey + 1)::INTEGER AS new_start, (l_suppkey + 1)::INTEGER AS new_end FROM lineitem)"
_query("diff_hunks", lambda r: validate.diff_hunks(_diffs(r)), f"WITH {_HUNKS} SELECT * FROM h")
_query(
    "touched_functions",
    lambda r: validate.touched_functions(validate.diff_hunks(_diffs(r)), _suppliers(r)),
    f"WITH {_HUNKS} SELECT DISTINCT patch_id, '/p/' || path AS path, s_name AS fn FROM h JOIN supplier ON path = 'src/m' || s_suppkey % 7 || '.c' AND s_suppkey <= new_end AND s_suppkey + 5 >= new_start",
)
_query(
    "repaired_paths",
    lambda r: validate.repaired_paths(r("nation").select(F.expr("CASE WHEN n_nationkey % 3 = 0 THEN concat('r', n_regionkey, '/', n_name, '.c') WHEN n_nationkey % 3 = 1 THEN concat('lost/', n_name, '.c') ELSE 'shared.c' END").alias("path")), r("nation").select(F.expr("concat('top/r', n_regionkey, '/', n_name, '.c')").alias("path")).union(r("region").select(F.expr("concat('top/', r_name, '/shared.c')")))).select("path", "repaired"),
    "SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'r' || n_regionkey || '/' || n_name || '.c' WHEN n_nationkey % 3 = 1 THEN 'lost/' || n_name || '.c' ELSE 'shared.c' END AS path, CASE WHEN n_nationkey % 3 < 2 THEN 'top/r' || n_regionkey || '/' || n_name || '.c' ELSE 'shared.c' END AS repaired FROM nation",
)
_query(
    "path_contexts",
    lambda r: r("part").select("p_partkey", F.expr("concat(CASE p_size % 4 WHEN 0 THEN '/w/sources/x/Tests/a.c' WHEN 1 THEN 'lib/vendor/b.c' WHEN 2 THEN 'out/autogen/tests/c.c' ELSE 'tests/projects/h/core/main.c' END)").alias("path")).select("p_partkey", F.array_join(S.deployment_contexts(F.col("path")), ",").alias("contexts")),
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'test_or_example_path' WHEN 1 THEN 'vendored_or_external_path' WHEN 2 THEN 'test_or_example_path,generated_code' ELSE '' END AS contexts FROM part",
)
_query("normalised_text", lambda r: r("documents").select("doc_id", F.md5(S.squeezed(F.col("text")).cast("binary")).alias("digest")), r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS digest FROM documents")
_query("truncated_text", lambda r: r("documents").select("doc_id", S.truncated(F.col("text"), 200).alias("text")), "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...[truncated]' ELSE text END AS text FROM documents")
_query(
    "listed_words",
    lambda r: r("conversations").select("conv_id", "turn", S.listed(S.distinct_in_order(F.split("text", " "))).alias("words")),
    """WITH s AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), d AS (SELECT conv_id, turn, list_filter(w, lambda x, i: list_position(w, x) = i) AS u FROM s)
SELECT conv_id, turn, array_to_string(u[1:5], ', ') || CASE WHEN len(u) > 5 THEN ', +' || (len(u) - 5) || ' more' ELSE '' END AS words FROM d""",
)
_query("safe_names", lambda r: r("pages").select("page_id", S.safe_name(F.col("url")).alias("name"), S.rule_key(F.col("url")).alias("key")), "SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g') AS name, trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM pages")
_query(
    "dataset_export",
    lambda r: r("labels").join(r("documents"), "doc_id").select("doc_id", "source", F.when(F.col("quality") == 1, "correct").otherwise("wrong").alias("label"), (F.col("quality") == 1).alias("strict"), ((F.col("quality") == 1) | (F.col("toxic") == 0)).alias("lenient"), F.coalesce("lang", F.lit("unknown")).alias("lang")),
    "SELECT doc_id, source, CASE WHEN quality = 1 THEN 'correct' ELSE 'wrong' END AS label, quality = 1 AS strict, quality = 1 OR toxic = 0 AS lenient, coalesce(lang, 'unknown') AS lang FROM labels JOIN documents USING (doc_id)",
)
_query(
    "callers_and_callees",
    lambda r: graph.callers_and_callees(r("lineitem").select(F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst")), "7"),
    "SELECT DISTINCT 'caller' AS role, l_suppkey::VARCHAR AS other FROM lineitem WHERE l_partkey = 7 UNION SELECT DISTINCT 'callee', l_partkey::VARCHAR FROM lineitem WHERE l_suppkey = 7",
)
_query(
    "run_comparison",
    lambda r: _findings(r).agg(*[F.count_if((F.col("status") == s) & (F.col("severity") == "critical")).alias(f"{n}_critical") for n, s in (("before", "O"), ("after", "F"))], *[F.count_if(F.col("status") == s).alias(n) for n, s in (("before", "O"), ("after", "F"))]).withColumn("delta", F.col("after") - F.col("before")).withColumn("critical_delta", F.col("after_critical") - F.col("before_critical")),
    f"WITH {FINDINGS}, a AS (SELECT count(*) FILTER (WHERE status = 'O') AS before, count(*) FILTER (WHERE status = 'F') AS after, count(*) FILTER (WHERE status = 'O' AND severity = 'critical') AS before_critical, count(*) FILTER (WHERE status = 'F' AND severity = 'critical') AS after_critical FROM f) SELECT *, after - before AS delta, after_critical - before_critical AS critical_delta FROM a",
)


def _spans(read: Callable[[str], DataFrame]) -> DataFrame:
    return read("supplier").select(F.expr("concat('m', s_suppkey % 7, '.c')").alias("path"), F.expr("concat('f', s_suppkey % 40)").alias("fn"), F.col("s_suppkey").cast("int").alias("start_line"), (F.col("s_suppkey") + 5).cast("int").alias("end_line"))


_SPANS = "s AS (SELECT 'm' || s_suppkey % 7 || '.c' AS path, 'f' || s_suppkey % 40 AS fn, s_suppkey AS start_line, s_suppkey + 5 AS end_line FROM supplier)"
_query(
    "function_lookup",
    lambda r: review.looked_up(r("customer").select("c_custkey", F.expr("concat('m', c_custkey % 9, '.c')").alias("path"), F.expr("concat('f', c_custkey % 60)").alias("fn"), (F.col("c_custkey") % 120).cast("int").alias("line")), _spans(r)).select("c_custkey", "found_path", "found_fn"),
    f"""WITH {_SPANS}, p AS (SELECT c_custkey, 'm' || c_custkey % 9 || '.c' AS path, 'f' || c_custkey % 60 AS fn, c_custkey % 120 AS line FROM customer),
e AS (SELECT p.c_custkey, max_by(s.fn, (s.start_line, s.fn)) AS fn FROM p JOIN s ON s.path = p.path AND p.line BETWEEN s.start_line AND s.end_line GROUP BY ALL),
n AS (SELECT fn, min_by(path, (path, start_line)) AS path FROM s GROUP BY fn), x AS (SELECT DISTINCT path, fn FROM s)
SELECT p.c_custkey, CASE WHEN x.fn IS NOT NULL THEN p.path WHEN n.fn IS NOT NULL THEN n.path WHEN e.fn IS NOT NULL THEN p.path END AS found_path, coalesce(x.fn, n.fn, e.fn) AS found_fn
FROM p LEFT JOIN x ON x.path = p.path AND x.fn = p.fn LEFT JOIN n ON n.fn = p.fn LEFT JOIN e USING (c_custkey)""",
)
_query(
    "stages_folded",
    lambda r: review.folded_stages(_stages(r).select(F.col("candidate_key").alias("work_id"), F.expr("array_position(array('compile', 'resource_consistency', 'semantic_equivalence', 'security_regression'), stage)").alias("ordinal"), "stage", "passed", F.array("stage").alias("logs"))).select("work_id", "passed", F.array_join("failed", ",").alias("failed"), F.size("logs").alias("logs")),
    f"WITH {CANDIDATES}, {_STAGES_SQL} SELECT candidate_key AS work_id, bool_and(passed) AS passed, coalesce(string_agg(stage, ',' ORDER BY list_position(['compile', 'resource_consistency', 'semantic_equivalence', 'security_regression'], stage)) FILTER (WHERE NOT passed), '') AS failed, 4 AS logs FROM s GROUP BY ALL",
)
_query(
    "candidates_folded",
    lambda r: review.folded_candidates(_candidates(r).select(F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("candidate"), (F.col("l_tax") < 0.01).alias("passed"), F.array("l_returnflag", "l_linestatus").alias("logs"))).select("work_id", "passed", F.array_join("messages", ";").alias("messages")),
    f"""WITH {CANDIDATES} SELECT l_partkey AS work_id, bool_or(l_tax < 0.01) AS passed, coalesce(string_agg('candidate ' || l_suppkey || ': ' || l_returnflag || ';' || 'candidate ' || l_suppkey || ': ' || l_linestatus, ';' ORDER BY l_suppkey) FILTER (WHERE NOT l_tax < 0.01), '') AS messages FROM c GROUP BY l_partkey""",
)
_query(
    "failure_reasons",
    lambda r: r("events").select("event_id", review.failure_reason(F.expr("CASE event_type WHEN 'signup' THEN 'Patch does not apply' WHEN 'view' THEN 'unsafe API usage increased' WHEN 'click' THEN 'RATE_LIMIT; test failed' WHEN 'error' THEN 'return statement forms changed' ELSE 'fine' END")).alias("reason")),
    "SELECT event_id, CASE event_type WHEN 'signup' THEN 'apply' WHEN 'view' THEN 'security' WHEN 'click' THEN 'model' WHEN 'error' THEN 'API' ELSE 'other' END AS reason FROM events",
)
_query(
    "reviews_with_defaults",
    lambda r: review.with_reviews(r("documents").select("doc_id", "source"), r("labels"), "doc_id", {"quality": -1, "toxic": -1}),
    "SELECT doc_id, source, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
)
_query(
    "candidate_numbers",
    lambda r: review.numbered_candidates(_candidates(r), "l_partkey", ["l_extendedprice", "l_suppkey"]).select("l_partkey", "l_suppkey", "number"),
    f"WITH {CANDIDATES} SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_suppkey)::INTEGER AS number FROM c",
)


#: Stages by name and by what they log; both decide the category.
_STAGE_NAMES, _STAGE_LOGS = ("compile", "apply_patch", "tests", "custom", "resource_consistency", "security_regression"), ("patch does not apply", "no such file", "rate_limit hit", "all quiet", "test x failed")


def _one_of(number: str, texts: tuple[str, ...]) -> str:
    return f"CASE {number} % {len(texts)} " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(texts)) + " END"


def _result(depth: int) -> str:
    """An order's validation as JSON, in words that both dialects share: two stages, and from there a candidate that holds the next level, down to o_orderkey % 6."""
    stage = lambda i: f"""'"' || {_one_of(f"(o_orderkey + {i})", _STAGE_NAMES)} || '": {{"passed": ' || CASE WHEN o_orderkey % {i + 3} = 0 THEN 'true' ELSE 'false' END || ', "logs": ["' || {_one_of(f"(o_orderkey + {2 * i})", _STAGE_LOGS)} || '"]}}'"""
    inner = f""" || CASE WHEN o_orderkey % 6 > {depth} THEN ', "candidate_{depth}": ' || {_result(depth + 1)} ELSE '' END""" if depth < 5 else ""
    return f"""'{{"passed": false, "logs": ["' || {_one_of(f"(o_orderkey + {depth})", ("quiet", "compile step failed", "quiet too"))} || '"], "stage_results": {{' || {stage(depth)} || ', "other": {{"passed": ' || CASE WHEN o_orderkey % {depth + 2} = 0 THEN 'true' ELSE 'false' END || ', "warnings": "odd"}}'{inner} || '}}}}'"""


VALIDATIONS = f"""CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '{{"passed": true, "stage_results": {{"compile": {{"passed": false}}}}}}' WHEN 2 THEN '{{"passed": false, "stage_results": {{"failure_taxonomy": {{"categories": ["llm_api_error", "compile_failure"], "category_counts": {{"compile_failure": 2, "llm_api_error": 1}}, "failed_stages": ["z.compile", "ask"], "primary_category": "compile_failure"}}}}}}'
 WHEN 3 THEN '{{"passed": false, "logs": ["the TEST of x", "has Failed"]}}' WHEN 4 THEN '{{"passed": false, "stage_results": {{"candidate_0": {{"passed": false, "stage_results": {{}}, "counterexamples": ["invalid_api_key"]}}, "note": "text"}}}}' ELSE {_result(0)} END"""


def _text_sql(*parts: str) -> str:
    listed = ", ".join(f"CASE json_type(j, '$.{p}') WHEN 'ARRAY' THEN CAST(json_extract(j, '$.{p}') AS VARCHAR[]) WHEN 'VARCHAR' THEN [json_extract_string(j, '$.{p}')] ELSE [] END" for p in parts)
    return f"lower(array_to_string(flatten([{listed}]), chr(10)))"


_TOLD = "CASE WHEN contains(t, 'insufficient_quota') OR contains(t, 'rate_limit') THEN 'llm_rate_limit' WHEN contains(t, 'invalid_api_key') OR contains(t, 'llm request failed') THEN 'llm_api_error' WHEN contains(t, 'compile') AND contains(t, 'failed') THEN 'compile_failure' WHEN contains(t, 'test') AND contains(t, 'failed') THEN 'test_failure' END"
_STAGE_TOLD = f"""CASE name WHEN 'compile' THEN 'compile_failure' WHEN 'tests' THEN 'test_failure' WHEN 'resource_consistency' THEN 'resource_regression' WHEN 'security_regression' THEN 'security_regression'
 WHEN 'apply_patch' THEN CASE WHEN contains(t, 'no such file') THEN 'path_mismatch' WHEN contains(t, 'apply') THEN 'patch_does_not_apply' ELSE 'unknown_validation_failure' END ELSE {_TOLD} END"""


def _taxonomy_sql(deepest: int) -> str:
    """The same level by level: n{d} results, s{d} their failed stages, r{d} their categories."""
    out = f"n0 AS (SELECT o_orderkey::VARCHAR AS node, NULL::VARCHAR AS parent, 0 AS pos, NULL::VARCHAR AS name, (v)::JSON AS j FROM (SELECT o_orderkey, {VALIDATIONS} AS v FROM orders))"
    for d in range(deepest + 1):
        out += f""",
s{d} AS (SELECT node AS parent, pos, name, j, {_text_sql("logs", "warnings", "counterexamples")} AS t, json_type(j, '$.stage_results') IS NOT DISTINCT FROM 'OBJECT' AS inner_one
  FROM (SELECT node, pos, keys[pos] AS name, json_extract(j, '$.stage_results."' || keys[pos] || '"') AS j FROM (SELECT node, j, json_keys(j, '$.stage_results') AS keys, generate_subscripts(json_keys(j, '$.stage_results'), 1) AS pos FROM n{d} WHERE (j->>'$.passed') <> 'true' AND json_extract(j, '$.stage_results.failure_taxonomy.categories') IS NULL))
  WHERE json_type(j) = 'OBJECT' AND coalesce((j->>'$.passed'), 'false') <> 'true'),
n{d + 1} AS (SELECT parent || '/' || pos AS node, parent, pos, name, j FROM s{d} WHERE inner_one)"""
    for d in range(deepest, -1, -1):
        inside = f" UNION ALL SELECT parent, pos, categories, list_transform(failed_stages, lambda f: name || '.' || f) FROM r{d + 1}" if d < deepest else ""
        out += f""",
p{d} AS (SELECT parent, pos, CASE WHEN {_STAGE_TOLD} IS NULL THEN []::VARCHAR[] ELSE [{_STAGE_TOLD}] END AS categories, [name] AS failed FROM s{d} WHERE NOT inner_one{inside}),
g{d} AS (SELECT parent, flatten(list(categories ORDER BY pos)) AS named, flatten(list(failed ORDER BY pos)) AS failed FROM p{d} GROUP BY parent),
c{d} AS (SELECT n.*, coalesce(g.failed, []::VARCHAR[]) AS failed, coalesce(g.named, []::VARCHAR[]) AS named, {_text_sql("logs", "counterexamples")} AS t FROM n{d} n LEFT JOIN g{d} g ON g.parent = n.node),
l{d} AS (SELECT *, CASE WHEN j IS NULL THEN ['missing_validation'] WHEN (j->>'$.passed') = 'true' THEN []::VARCHAR[] WHEN len(named) > 0 THEN named WHEN {_TOLD} IS NOT NULL THEN [{_TOLD}] WHEN len(failed) > 0 THEN ['unknown_validation_failure'] ELSE []::VARCHAR[] END AS own,
  json_extract(j, '$.stage_results.failure_taxonomy') AS e FROM c{d}),
r{d} AS (SELECT node, parent, pos, name, CASE WHEN e IS NOT NULL THEN CAST(json_extract(e, '$.categories') AS VARCHAR[]) ELSE list_sort(list_distinct(own)) END AS categories,
  CASE WHEN e IS NOT NULL THEN 'compile_failure=2,llm_api_error=1' ELSE array_to_string(list_transform(list_sort(list_distinct(own)), lambda c: c || '=' || len(list_filter(own, lambda x: x = c))), ',') END AS counts,
  CASE WHEN e IS NOT NULL THEN CAST(json_extract(e, '$.failed_stages') AS VARCHAR[]) ELSE failed END AS failed_stages, CASE WHEN e IS NOT NULL THEN (e->>'$.primary_category') ELSE list_sort(list_distinct(own))[1] END AS primary_category FROM l{d})"""
    return f"WITH {out} SELECT node::BIGINT AS work_id, array_to_string(categories, ',') AS categories, counts, array_to_string(failed_stages, ',') AS failed_stages, primary_category FROM r0"


_query(
    "nested_taxonomy",
    lambda r: nested_taxonomy(r("orders").select(F.col("o_orderkey").alias("work_id"), F.expr(VALIDATIONS).alias("validation"))).select(
        "work_id", F.array_join("categories", ",").alias("categories"), F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("counts"), F.array_join("failed_stages", ",").alias("failed_stages"), "primary_category"
    ),
    _taxonomy_sql(6),
)


_query(
    "enclosing_function",
    lambda r: review.enclosing_function(r("orders").select("o_orderkey", F.expr("concat('m', o_custkey % 9, '.c')").alias("path"), (F.col("o_orderkey") % 250).cast("int").alias("line")), _spans(r)).select("o_orderkey", "enclosing"),
    f"""WITH {_SPANS} SELECT o_orderkey, max_by(s.fn, (s.start_line, s.fn)) AS enclosing FROM orders LEFT JOIN s ON s.path = 'm' || o_custkey % 9 || '.c' AND o_orderkey % 250 BETWEEN s.start_line AND s.end_line GROUP BY o_orderkey""",
)

_CLAIMED = "o_orderkey AS id, concat('m', o_custkey % 9, '.c') AS path, CAST(o_orderkey % 250 AS INT) AS line, CASE o_orderkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, CASE o_custkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE NULL END AS impact, CAST(o_orderkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence"
_LABEL = "CASE WHEN %s >= 0.80 THEN 'high' WHEN %s >= 0.55 THEN 'medium' ELSE 'low' END"
_VERDICT = "CASE WHEN {0} >= 0.85 THEN 'true_positive' WHEN {0} >= 0.65 THEN 'likely' WHEN {0} >= 0.45 THEN 'unclear' ELSE 'false_positive' END"


def _claimed(read: Callable[[str], DataFrame]) -> DataFrame:
    rows = read("orders").select(*[F.expr(c) for c in re.split(r", (?=o_orderkey|concat|CAST|CASE)", _CLAIMED)])
    return rows.withColumns({"evidence": S.evidence_label(F.col("confidence")), "verdict": S.verdict(F.col("confidence"))})


_query(
    "confirmed_findings",
    lambda r: findings.confirmed(_claimed(r), _spans(r)).select("id", "confirmation", "confidence", "evidence", "verdict", "severity"),
    f"""WITH {_SPANS}, f AS (SELECT {_CLAIMED} FROM orders), g AS (SELECT *, {_LABEL.replace("%s", "confidence")} AS evidence, {_VERDICT.format("confidence")} AS verdict, coalesce(impact, severity) AS own FROM f),
t AS (SELECT *, severity IN ('critical', 'high') OR (own IN ('critical', 'high') AND evidence = 'high') OR (confidence >= 0.95 AND own IN ('critical', 'high', 'medium')) AS tried,
  EXISTS (FROM s WHERE s.path = g.path AND g.line BETWEEN s.start_line AND s.end_line) AS seen FROM g),
c AS (SELECT *, CASE WHEN NOT tried THEN confidence ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence * CASE WHEN seen THEN 1.05::DOUBLE ELSE 0.75::DOUBLE END)) END AS score FROM t),
e AS (SELECT *, {_LABEL.replace("%s", "score")} AS label FROM c)
SELECT id, CASE WHEN NOT tried THEN 'skipped' WHEN seen THEN 'confirmed' ELSE 'unconfirmed' END AS confirmation, CASE WHEN tried THEN round_even(score, 3) ELSE confidence END AS confidence, label AS evidence, {_VERDICT.format("score")} AS verdict,
  CASE WHEN NOT tried THEN severity ELSE ['low', 'medium', 'high', 'critical'][least(list_position(['low', 'medium', 'high', 'critical'], own), CASE label WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END)] END AS severity FROM e""",
)
