"""Queries of patches, runs, reports, function context and compilers' output, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import code_queries, vocab
from .operators import context, facts, graph, patching, runs
from .operators.lex import functions
from .plans import report
from .plans.rounds import repair_rounds
from .sources import clang
from .sources.corpus import lines_cte
from .table_queries import FINDINGS, _findings, _rate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, of: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: of(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    SQL[name] = sql


def _code(name: str, of: Callable[..., DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: of(code_queries._tables(spark, sf_dir))
    SQL[name] = f"WITH {lines_cte()}, {code_queries.EVENTS_CTE} {sql}"


# --- patches: a small function for each nation, a patch for each supplier


def _nation_files(read: Callable[[str], DataFrame]) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("int f_"), key, F.lit("(char *p, int x) {\n    p = malloc(x);\n    free(p);\n    return 0;\n}\n"))
    return read("nation").select(F.concat(F.lit("src/n"), key, F.lit(".c")).alias("path"), text.alias("content"))


def _supplier_diffs(read: Callable[[str], DataFrame]) -> DataFrame:
    """By s_suppkey % 6: nothing, a hunk that fits nowhere, one without a change, one that drops the release, one that adds a line a line further down than it says, a file that isn't there."""
    key = F.col("s_nationkey").cast("string")
    head = lambda p: F.concat(F.lit(f"--- a/{p}"), key, F.lit(f".c\n+++ b/{p}"), key, F.lit(".c\n"))
    kind = F.col("s_suppkey") % 6
    own = head("src/n")
    diff = (
        F.when(kind == 0, F.lit(" \n")).when(kind == 1, F.concat(own, F.lit("@@ -1,2 +1,2 @@\n nothing of this\n-is there\n+at all\n"))).when(kind == 2, F.concat(own, F.lit("@@ -3,2 +3,2 @@\n     free(p);\n     return 0;\n")))
        .when(kind == 3, F.concat(own, F.lit("@@ -2,3 +2,2 @@\n     p = malloc(x);\n-    free(p);\n     return 0;\n"))).when(kind == 4, F.concat(own, F.lit("@@ -2,2 +2,3 @@\n     free(p);\n+    x = "), "s_suppkey", F.lit(";\n     return 0;\n")))
        .otherwise(F.concat(head("none"), F.lit("@@ -1 +1 @@\n-a\n+b\n")))
    )
    return read("supplier").select(F.col("s_suppkey").alias("patch_id"), diff.alias("diff"))


_query(
    "patched_trees",
    lambda r: patching.patched_files(_nation_files(r), _supplier_diffs(r)).select("patch_id", "path", F.coalesce("problem", F.lit("")).alias("problem"), F.md5(F.coalesce("after", F.lit("")).cast("binary")).alias("digest")),
    r"""WITH s AS (SELECT s_suppkey, s_suppkey % 6 AS kind, s_nationkey AS n, 'int f_' || s_nationkey || '(char *p, int x) {' || chr(10) || '    p = malloc(x);' || chr(10) AS head, '    free(p);' || chr(10) AS free, '    return 0;' || chr(10) || '}' || chr(10) AS tail FROM supplier)
SELECT s_suppkey AS patch_id, CASE WHEN kind = 5 THEN 'none' ELSE 'src/n' END || n || '.c' AS path, CASE kind WHEN 1 THEN 'patch does not apply: hunk at line 1' WHEN 5 THEN 'no such file: none' || n || '.c' ELSE '' END AS problem,
  md5(CASE kind WHEN 2 THEN head || free || tail WHEN 3 THEN head || tail WHEN 4 THEN head || free || '    x = ' || s_suppkey || ';' || chr(10) || tail ELSE '' END) AS digest FROM s WHERE kind > 0""",
)
_query(
    "patch_stages",
    lambda r: patching.validate_patches(_nation_files(r), _supplier_diffs(r)).select("patch_id", "ordinal", "stage", "passed", "text"),
    r"""WITH s AS (SELECT s_suppkey AS patch_id, s_suppkey % 6 AS kind, s_nationkey AS n FROM supplier),
a AS (SELECT patch_id, 0 AS ordinal, 'apply_patch' AS stage, kind IN (3, 4) AS passed, CASE kind WHEN 0 THEN 'empty patch' WHEN 1 THEN 'patch does not apply: hunk at line 1' WHEN 2 THEN 'patch made no project changes' WHEN 5 THEN 'no such file: none' || n || '.c' ELSE 'applied' END AS text FROM s),
t(ordinal, stage) AS (VALUES (1, 'compile'), (2, 'tests'), (3, 'static_analysis'), (4, 'resource_consistency'), (5, 'semantic_equivalence'), (6, 'security_regression'))
SELECT * FROM a UNION ALL SELECT patch_id, ordinal, stage, ordinal < 4 OR kind = 4, CASE WHEN ordinal < 4 THEN 'nothing to run' WHEN kind = 4 THEN '' ELSE 'src/n' || n || '.c: f_' || n || ': ' || CASE ordinal
  WHEN 4 THEN 'p acquired via alloc at line 2 lacks matching free' WHEN 5 THEN 'externally visible calls changed' ELSE 'releases decreased from 1 to 0' END END FROM s CROSS JOIN t WHERE kind IN (3, 4)""",
)
_query(
    "tree_diffs",
    lambda r: runs.tree_diff(
        r("nation").where("n_nationkey <> 3").select(F.concat("n_name", F.lit(".txt")).alias("path"), F.concat(F.lit("line of "), F.col("n_regionkey").cast("string")).alias("content")),
        r("nation").where("n_nationkey <> 4").select(F.concat("n_name", F.lit(".txt")).alias("path"), F.concat(F.lit("line of "), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).otherwise(9).cast("string")).alias("content")),
    ),
    r"""SELECT n_name || '.txt' AS path, '--- a/' || n_name || '.txt' || chr(10) || '+++ b/' || n_name || '.txt' || chr(10) || CASE WHEN n_nationkey = 3 THEN '@@ -0,0 +1 @@' WHEN n_nationkey = 4 THEN '@@ -1 +0,0 @@' ELSE '@@ -1 +1 @@' END
  || CASE WHEN n_nationkey = 3 THEN '' ELSE chr(10) || '-line of ' || n_regionkey END || CASE WHEN n_nationkey = 4 THEN '' ELSE chr(10) || '+line of 9' END AS diff FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey = 4""",
)

# --- what functions do, on the generated corpus

_TOKENS = r"""
t_goto AS (SELECT path, fn, t, min(line * 1000 + k) AS pos FROM (SELECT path, fn, line, unnest(x) AS t, unnest(range(1, len(x) + 1)) AS k FROM (SELECT *, regexp_extract_all(stmt, '\bgoto\s+\w+\s*;') AS x FROM code_lines)) GROUP BY ALL),
t_label AS (SELECT path, fn, regexp_extract(stmt, '^(\w+)\s*:', 1) AS t, min(line) AS pos FROM code_lines WHERE regexp_matches(stmt, '^\w+\s*:') GROUP BY ALL),
t_return AS (SELECT path, fn, regexp_extract(stmt, '\breturn\b[^;]*;') AS t, min(line) AS pos FROM code_lines WHERE regexp_matches(stmt, '\breturn\b') GROUP BY ALL),
t_call AS (SELECT path, fn, t, min(line * 1000 + k) AS pos FROM (SELECT path, fn, line, unnest(x) AS t, unnest(range(1, len(x) + 1)) AS k FROM (SELECT *, regexp_extract_all(stmt, '\b([A-Za-z_]\w*)\s*\(', 1) AS x FROM code_lines)) WHERE t NOT IN ('if', 'for', 'while', 'switch', 'return', 'sizeof') GROUP BY ALL),
fns AS (SELECT DISTINCT path, fn FROM code_lines)"""


def _listed(values: str) -> str:
    return f"CASE WHEN coalesce(len({values}), 0) = 0 THEN 'none' WHEN len({values}) > 5 THEN array_to_string({values}[1:5], ', ') || ', +' || (len({values}) - 5) || ' more' ELSE array_to_string({values}, ', ') END"


_code(
    "error_paths",
    lambda t: context.error_paths(t.functions, t.events).select("path", "fn", F.array_join("paths", " | ").alias("paths")),
    rf""", {_TOKENS},
p AS (SELECT path, fn, 1 AS part, pos, t FROM t_goto WHERE regexp_matches(lower(t), 'error|err|fail|cleanup|out') UNION ALL SELECT path, fn, 2, pos, 'label ' || t FROM t_label WHERE regexp_matches(lower(t), 'error|err|fail|cleanup|out')
  UNION ALL SELECT path, fn, 3, pos, t FROM t_return WHERE regexp_matches(lower(t), 'null|-1|false|err|error') UNION ALL SELECT path, fn, 4, row_number() OVER (PARTITION BY path, fn ORDER BY line, kind, call, variable), kind || ' ' || variable || ' at line ' || line FROM ev WHERE kind IN ('free', 'close', 'unlock'))
SELECT path, fn, coalesce(string_agg(t, ' | ' ORDER BY part, pos), '') AS paths FROM fns LEFT JOIN p USING (path, fn) GROUP BY path, fn""",
)
_code(
    "side_effects",
    lambda t: context.side_effects(t.functions, t.events).join(context.return_summaries(t.functions), ["path", "fn", "ordinal"]).select("path", "fn", "effects", "returns"),
    rf""", {_TOKENS},
c AS (SELECT path, fn, list(t ORDER BY pos) AS c FROM t_call GROUP BY ALL), r AS (SELECT path, fn, list(t ORDER BY pos) AS r FROM t_return GROUP BY ALL),
e AS (SELECT path, fn, list(kind || '(' || variable || ')' ORDER BY line, kind, call, variable) AS e FROM ev GROUP BY ALL)
SELECT path, fn, CASE WHEN c IS NULL AND e IS NULL THEN 'No obvious calls or resource events.' ELSE concat_ws('; ', CASE WHEN c IS NOT NULL THEN 'calls ' || {_listed("c")} END, CASE WHEN e IS NOT NULL THEN 'resource events ' || {_listed("e")} END) END AS effects,
  CASE WHEN r IS NULL THEN 'No explicit return statements.' ELSE {_listed("r")} END AS returns FROM fns LEFT JOIN c USING (path, fn) LEFT JOIN e USING (path, fn) LEFT JOIN r USING (path, fn)""",
)
_code(
    "resource_edges",
    lambda t: context.resource_edges(t.functions, t.events).select("path", "src", "dst", "edge"),
    "SELECT DISTINCT path, fn || ':bb1' AS src, 'resource:' || fn || ':' || CASE WHEN variable <> '' THEN variable ELSE kind END || ':' || line AS dst, 'resource' AS edge FROM ev",
)
_DEFINED = r"""
d AS (SELECT DISTINCT path, fn, variable FROM (SELECT path, fn, regexp_extract(stmt, '^([a-z]\w*)\s*(=|\+\+)', 1) AS variable FROM code_lines WHERE regexp_matches(stmt, '^[a-z]\w*\s*(=|\+\+)') AND NOT regexp_matches(stmt, '^(if|return|goto)\b')
  UNION ALL SELECT path, fn, regexp_extract(stmt, '^[a-z]\w* = ([A-Za-z_]\w*)[(;]', 1) FROM code_lines WHERE regexp_matches(stmt, '^[a-z]\w* = [A-Za-z_]\w*[(;]'))),
u AS (SELECT DISTINCT path, fn, variable FROM (SELECT path, fn, unnest(regexp_extract_all(stmt, '\b[A-Za-z_]\w*\b')) AS variable FROM (SELECT path, fn, trim(regexp_replace(raw, '//.*$', '')) AS stmt FROM code_lines)) WHERE variable <> fn AND NOT variable IN (KEYWORDS))""".replace("KEYWORDS", ", ".join(f"'{k}'" for k in vocab.C_KEYWORDS))
_code(
    "data_edges",
    lambda t: graph.data_edges(t.functions).select("path", "src", "dst").distinct(),
    f", {_DEFINED} SELECT path, fn || ':bb1' AS src, 'var:' || fn || ':' || variable AS dst FROM d UNION ALL SELECT path, 'var:' || fn || ':' || variable, fn || ':bb1' FROM u SEMI JOIN d USING (path, fn, variable)",
)
_code("variable_uses", lambda t: facts.uses(t.functions).select("path", "fn", "variable").distinct(), f", {_DEFINED} SELECT path, fn, variable FROM u")
_code(
    "index_counts",
    lambda t: context.index_counts(t.functions, t.lines, t.events.select("path", "fn", "line", "kind", "variable", "call"), F.when(F.col("path").startswith("src"), "regex")),
    """SELECT 'functions by ' || CASE WHEN starts_with(path, 'src') THEN 'regex' ELSE 'unknown' END AS what, count(*) AS n FROM (SELECT DISTINCT path, fn FROM code_lines) GROUP BY ALL
UNION ALL SELECT 'functions', count(*) FROM (SELECT DISTINCT path, fn FROM code_lines) UNION ALL SELECT 'blocks', count(*) FROM code_lines UNION ALL SELECT 'edges', count(*) FROM ev""",
)
_query(
    "adjacency",
    lambda r: context.adjacency(r("lineitem").select(F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"))).select("src", F.size("callees").cast("long").alias("n"), F.md5(F.array_join("callees", ",").cast("binary")).alias("digest")),
    "SELECT src, count(*) AS n, md5(string_agg(dst, ',' ORDER BY dst COLLATE \"C\")) AS digest FROM (SELECT DISTINCT l_suppkey::VARCHAR AS src, l_partkey::VARCHAR AS dst FROM lineitem) GROUP BY src",
)
_HINTED = "CASE p_size % 6 WHEN 0 THEN 'buf_release' WHEN 1 THEN 'list_append' WHEN 2 THEN 'peek_at' WHEN 3 THEN 'Take_And_Free' WHEN 4 THEN 'plain' ELSE 'xyz' END"
_query(
    "ownership_evidence",
    lambda r: context.ownership_evidence(r("part").select(F.col("p_partkey").cast("string").alias("path"), F.expr(_HINTED).alias("fn"), F.lit(0).alias("ordinal"), F.expr("CASE WHEN p_size % 4 = 0 THEN 'fclose (f);' ELSE 'freed(x);' END").alias("body"))).select(
        F.col("path").cast("long").alias("p_partkey"), "releases", "transfers", "borrows", F.array_join("evidence", ",").alias("evidence")
    ),
    f"""WITH f AS (SELECT p_partkey, lower({_HINTED}) AS fn, p_size % 4 = 0 AS body FROM part),
h AS (SELECT *, regexp_matches(fn, '{"|".join(vocab.RELEASE_HINTS)}') AS r, regexp_matches(fn, '{"|".join(vocab.TRANSFER_HINTS)}') AS transfers, regexp_matches(fn, '{"|".join(vocab.BORROW_HINTS)}') AS borrows FROM f)
SELECT p_partkey, r OR body AS releases, transfers, borrows, concat_ws(',', CASE WHEN r THEN 'named like a release' END, CASE WHEN transfers THEN 'named like a hand-over' END, CASE WHEN borrows THEN 'named like a borrower' END, CASE WHEN body THEN 'frees or closes something itself' END) AS evidence FROM h""",
)

# --- runs and reviews: orders as work items

_query(
    "claimable_work",
    lambda r: runs.claimable(_findings(r).select(F.col("id").alias("work_id"), "project"), runs.completed(r("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("work_id")), r("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("work_id"))),
        r("orders").where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("work_id"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey") % 1000).alias("reserved_at")), F.lit(1000), 300.0),
    f"""WITH {FINDINGS} SELECT id AS work_id, project FROM f JOIN orders ON o_orderkey = id WHERE status <> 'P' AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
  AND NOT (o_custkey % 3 = 0 AND 1000 - CASE WHEN id % 7 > 0 THEN id % 1000 ELSE 0 END <= 300)""",
)
_query(
    "claim_files",
    lambda r: r("pages").select("page_id", runs.claim_file(F.col("url")).alias("file")),
    r"SELECT page_id, left(regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g'), 120) || '-' || left(sha256(url), 16) || '.lock' AS file FROM pages",
)
_query(
    "next_claims",
    lambda r: runs.next_claims(r("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("work_id")), 7, ["work_id"]),
    "SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::INTEGER AS worker, o_orderkey AS work_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 7",
)
_RESULTS = "array(CASE WHEN id % 5 = 0 THEN 'compile' END, CASE WHEN id % 3 = 0 THEN 'security_regression' END)"
_query(
    "run_summary",
    lambda r: runs.run_summary(
        _findings(r).select(F.col("id").alias("work_id"), "severity", F.col("project").alias("kind")),
        _findings(r).where("status <> 'P'").select(F.col("id").alias("work_id"), F.when(F.col("project") != "FRANCE", F.col("project")).alias("project"), "status", "severity", F.expr("nullif(severity, 'low')").alias("kind"), (F.col("id") % 2 == 0).alias("selected"), F.expr("CASE WHEN id % 4 = 0 THEN true WHEN id % 4 = 1 THEN false END").alias("passed"),
            F.expr(f"filter({_RESULTS}, x -> x IS NOT NULL)").alias("failed_stages"), F.expr("array(CASE WHEN id % 3 = 0 THEN 'security' ELSE 'none' END)").alias("categories")),
    ),
    f"""WITH {FINDINGS}, r AS (SELECT *, nullif(project, 'FRANCE') AS p FROM f WHERE status <> 'P')
SELECT 'queue_size' AS what, '' AS name, count(*) AS n FROM f UNION ALL SELECT 'processed', '', count(*) FROM r UNION ALL SELECT 'pending', '', (SELECT count(*) FROM f) - (SELECT count(DISTINCT id) FROM r)
UNION ALL SELECT 'selected_patches', '', count(*) FROM r WHERE id % 2 = 0 UNION ALL SELECT 'validation_passed', '', count(*) FROM r WHERE id % 4 = 0
UNION ALL SELECT 'status_counts', status, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'queue_severity_counts', severity, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'queue_kind_counts', project, count(*) FROM f GROUP BY ALL
UNION ALL SELECT 'processed_severity_counts', severity, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'processed_kind_counts', CASE WHEN severity = 'low' THEN 'None' ELSE severity END, count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'failed_stage_counts', 'compile', count(*) FROM r WHERE id % 5 = 0 UNION ALL SELECT 'failed_stage_counts', 'security_regression', count(*) FROM r WHERE id % 3 = 0
UNION ALL SELECT 'failure_category_counts', CASE WHEN id % 3 = 0 THEN 'security' ELSE 'none' END, count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'projects_processed', coalesce(p, 'unknown'), count(*) FROM r GROUP BY ALL UNION ALL SELECT 'projects_passed', coalesce(p, 'unknown'), count(*) FROM r WHERE id % 4 = 0 GROUP BY ALL""",
)
_CATEGORY = "CASE o_orderkey % 6 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(vocab.FAILURE_CATEGORIES[:5])) + " END"
_query(
    "failure_columns",
    lambda r: runs.failure_columns(r("orders").select(F.col("o_orderpriority").alias("system")).union(r("region").select("r_name")), r("orders").select(F.col("o_orderpriority").alias("system"), F.expr(_CATEGORY).alias("failure_category"))),
    f"WITH v AS (SELECT o_orderpriority AS system, coalesce({_CATEGORY}, 'unclear') AS c FROM orders), s AS (SELECT DISTINCT system FROM v UNION SELECT r_name FROM region) SELECT system, count(c) AS failed_patches, " + ", ".join(f"count(*) FILTER (WHERE c = '{c}') AS {c}" for c in vocab.FAILURE_CATEGORIES) + " FROM s LEFT JOIN v USING (system) GROUP BY system",
)
_LABEL = "CASE o_orderkey % 5 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'likely_true_positive' WHEN 2 THEN 'unclear' ELSE 'false_positive' END"
_query(
    "detector_precision",
    lambda r: runs.detector_precision(r("orders").select(F.expr(_LABEL).alias("label"), (F.col("o_custkey") % 2 == 0).alias("security_relevant"), F.expr("CASE WHEN o_custkey % 3 = 0 THEN true END").alias("resource_relevant"))),
    f"""WITH v AS (SELECT {_LABEL} AS label, o_custkey FROM orders), c AS (SELECT count(*) AS reviewed, count(*) FILTER (WHERE label = 'true_positive') AS true_positive, count(*) FILTER (WHERE label = 'likely_true_positive') AS likely_true_positive,
  count(*) FILTER (WHERE label = 'false_positive') AS false_positive, count(*) FILTER (WHERE label = 'unclear') AS unclear, count(*) FILTER (WHERE o_custkey % 2 = 0) AS security_relevant, count(*) FILTER (WHERE o_custkey % 3 = 0) AS resource_relevant FROM v)
SELECT *, {_rate("true_positive", "reviewed")} AS strict_precision, {_rate("(true_positive + likely_true_positive)", "reviewed")} AS lenient_precision, {_rate("false_positive", "reviewed")} AS false_positive_rate FROM c""",
)


def _run(read: Callable[[str], DataFrame], status: str) -> DataFrame:
    own = read("orders").where(F.col("o_orderstatus") == status)
    rows = own.select((F.col("o_custkey") % 3).cast("int").alias("candidates"), (F.col("o_custkey") % 2 == 0).alias("applied"), (F.col("o_custkey") % 10 == 0).alias("passed"), F.expr("CASE WHEN o_orderkey % 7 = 0 THEN array('compile', 'security_regression') ELSE array('compile') END").alias("failed_stages"),
        F.expr("CASE WHEN o_orderkey % 11 = 0 THEN array('x', 'DOUBLE free of p') END").alias("counterexamples"))
    return runs.run_numbers(read("orders"), rows)


_RUN_SQL = """SELECT (SELECT count(*) FROM orders) AS queue_size, count(*) AS processed, sum(o_custkey % 3) AS generated, count(*) FILTER (WHERE o_custkey % 2 = 0) AS applicable, count(*) FILTER (WHERE o_custkey % 10 = 0) AS passed,
  count(*) FILTER (WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0) AS unsafe_regressions, round(100.0::DOUBLE * applicable / processed, 2) AS apply_rate, round(100.0::DOUBLE * passed / processed, 2) AS pass_rate FROM orders WHERE o_orderstatus = 'STATUS'"""
_query(
    "run_deltas",
    lambda r: runs.run_deltas(_run(r, "O"), _run(r, "F")),
    "WITH b AS (" + _RUN_SQL.replace('STATUS', 'O') + "), a AS (" + _RUN_SQL.replace('STATUS', 'F') + ") " + " UNION ALL ".join(f"SELECT '{m}' AS metric, b.{m}::DOUBLE AS before, a.{m}::DOUBLE AS after, round(a.{m}::DOUBLE - b.{m}::DOUBLE, 2) AS delta FROM a, b" for m in ("queue_size", "processed", "generated", "applicable", "passed", "unsafe_regressions", "apply_rate", "pass_rate")),
)
_query(
    "stage_deltas",
    lambda r: runs.stage_deltas(*[r("lineitem").where((F.col("l_linestatus") == s) & (F.col("l_linenumber") != k)).select(F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("stage")) for s, k in (("O", 3), ("F", 5))]),
    "SELECT 's' || l_linenumber AS stage, count(*) FILTER (WHERE l_linestatus = 'O' AND l_linenumber <> 3) AS before, count(*) FILTER (WHERE l_linestatus = 'F' AND l_linenumber <> 5) AS after, after - before AS delta FROM lineitem GROUP BY ALL HAVING before + after > 0",
)
_KEYS = "CASE p_size % 8 WHEN 0 THEN 'malloc/free' WHEN 1 THEN ' Goto-Cleanup ' WHEN 2 THEN 'repeated null checks' WHEN 3 THEN 'SMELL' WHEN 4 THEN 'validation' WHEN 5 THEN 'general' WHEN 6 THEN '' ELSE 'other' END"
_query(
    "rule_families",
    lambda r: r("part").select("p_partkey", runs.rule_family(F.expr(_KEYS)).alias("family")),
    "SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'resource_management' WHEN 1 THEN 'error_handling' WHEN 2 THEN 'validation' WHEN 3 THEN 'security_smells' WHEN 4 THEN 'validation' ELSE 'general' END AS family FROM part",
)
_query(
    "all_sources",
    lambda r: runs.all_sources(*[r(t).select(F.expr(f"concat('f', {k} % 50, '.c')").alias("path"), F.lit(v).alias("language")) for t, k, v in (("customer", "c_custkey", "project"), ("supplier", "s_suppkey", "functions"))]),
    "SELECT path, CASE WHEN path IN (SELECT 'f' || s_suppkey % 50 || '.c' FROM supplier) THEN 'functions' ELSE 'project' END AS language FROM (SELECT DISTINCT 'f' || c_custkey % 50 || '.c' AS path FROM customer UNION SELECT 'f' || s_suppkey % 50 || '.c' FROM supplier)",
)
_query(
    "compact_records",
    lambda r: r("orders").select("o_orderkey", runs.compact_json(F.struct("o_orderstatus", "o_orderpriority"), 40).alias("record"), F.array_join(runs.head_of(F.split("o_orderpriority", ""), 3), "").alias("head")),
    """SELECT o_orderkey, CASE WHEN length(j) > 40 THEN left(j, 40) || '...[truncated]' ELSE j END AS record, left(o_orderpriority, 3) AS head FROM (SELECT *, '{"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' AS j FROM orders)""",
)

# --- the report: a supplier is an opportunity


def _reported(read: Callable[[str], DataFrame]) -> DataFrame:
    s = read("supplier").withColumn("k", F.col("s_suppkey").cast("int"))
    key = F.col("s_suppkey").cast("string").alias("opportunity_id")
    opportunities = s.select(key, F.col("k").alias("number"), F.expr("CASE k % 4 WHEN 0 THEN 'resource_imbalance' WHEN 1 THEN 'duplicate_check' WHEN 2 THEN 'security_smell' ELSE 'dead_code' END").alias("kind"), F.col("s_name").alias("description"), (F.col("k") % 8 == 1).alias("safe_to_remove"))
    plans = s.where("k % 3 <> 0").select(key, F.lit("Do it.").alias("intent"), F.when(F.col("k") % 5 == 0, "Use a Helper").otherwise("small").alias("strategy"), F.when(F.col("k") % 2 == 1, "checks").alias("constraint"))
    diff = F.concat(F.lit("--- a/x.c\n+++ b/x.c\n@@ -1,1 +1,9 @@\n-old\n"), F.repeat(F.lit("+new\n"), F.col("j") * 3))
    candidates = s.where("k % 4 > 0").select(key, "k", F.explode(F.expr("sequence(1, k % 4)")).alias("j"))
    candidates = candidates.select("opportunity_id", F.concat_ws("-", "opportunity_id", F.col("j").cast("string")).alias("candidate_id"), F.col("j").alias("place"), ((F.col("k") % 5 == 0) & (F.col("j") == 1 + F.col("k") % 2)).alias("selected"), diff.alias("diff"), F.lit(None).cast("string").alias("explanation"))
    validations = s.where("k % 2 = 1").select(key, (F.col("k") % 4 == 1).alias("passed"), F.expr("CASE WHEN k % 3 = 0 THEN array('a', 'b', 'c', 'd') ELSE array() END").alias("counterexamples"), F.expr("CASE WHEN k % 3 = 1 THEN array('log') END").alias("logs"))
    return report.report(opportunities, plans, report.patch_records(opportunities, candidates), validations)


_query(
    "report_rows",
    lambda r: _reported(r).select("number", "kind", "explanation", F.array_join("files_changed", ",").alias("files"), "lines_added", "lines_removed", F.coalesce(F.array_join("failed_candidates", ",", "-"), F.lit("")).alias("failed"), F.coalesce("failure_reason", F.lit("")).alias("reason"), "security_impact", "performance",
        F.array_join("candidate_ids", ",").alias("candidates"), F.array_join("selected_paths", ",").alias("selected")),
    """WITH s AS (SELECT s_suppkey::INTEGER AS k, s_name, s_suppkey % 4 AS m, CASE WHEN s_suppkey % 5 = 0 AND 1 + s_suppkey % 2 <= s_suppkey % 4 THEN (1 + s_suppkey % 2)::INTEGER END AS chosen, s_suppkey % 4 = 3 AS failed FROM supplier),
x AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'a; b; c' WHEN k % 3 = 1 THEN 'log' ELSE 'validation failed' END AS why FROM s)
SELECT k AS number, CASE m WHEN 0 THEN 'resource_imbalance' WHEN 1 THEN 'duplicate_check' WHEN 2 THEN 'security_smell' ELSE 'dead_code' END AS kind,
  CASE WHEN k % 3 <> 0 THEN 'Do it.' ELSE s_name END || CASE WHEN chosen IS NULL THEN ' No patch selected.' ELSE ' Selected patch.' END AS explanation,
  CASE WHEN chosen IS NULL THEN '' ELSE 'x.c' END AS files, coalesce(3 * chosen, 0) AS lines_added, CASE WHEN chosen IS NULL THEN 0 ELSE 1 END AS lines_removed,
  CASE WHEN failed THEN array_to_string(list_transform(list_filter([1, 2, 3], lambda j: j IS DISTINCT FROM chosen), lambda j: k || '-' || j), ',') ELSE '' END AS failed, CASE WHEN failed THEN why ELSE '' END AS reason,
  CASE WHEN failed THEN 'Open: the patch did not pass (' || why || ').' WHEN m = 0 THEN 'Resources should be released more safely, in the same order.' WHEN m = 1 AND k % 8 = 1 THEN 'A repeated check may go; evidence that this is safe is kept.' WHEN m = 1 THEN 'It isn''t shown that the repeated check may go; checks should stay as they are.' ELSE 'Sensitive code should be easier to review, with no check weakened.' END AS security_impact,
  CASE WHEN chosen IS NULL THEN 'Unknown: no patch was selected.' WHEN k % 3 <> 0 AND k % 5 = 0 THEN 'Low to moderate: a helper adds a call and saves repetition.' WHEN 3 * chosen + 1 <= 8 THEN 'Negligible: the change is small and local.' ELSE 'Low: nothing costly is added.' END AS performance,
  array_to_string(list_transform(range(1, m + 1), lambda j: k || '-' || j), ',') AS candidates, CASE WHEN chosen IS NULL THEN '' ELSE 'patches/opportunity-' || lpad(k::VARCHAR, greatest(3, length(k::VARCHAR))::INTEGER, '0') || '-selected.diff' END AS selected FROM x""",
)

# --- compilers' output: trees for nations with an even key, flow of all


def _trees(read: Callable[[str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    files = read("nation").select("n_nationkey", F.format_string("src/n%d.c", "n_nationkey").alias("path"), F.format_string("int unused(int);\nstatic int f_%d(int x)\n{\n    return x;\n}\n", "n_nationkey").alias("content"))
    place = lambda line: f'{{"line": {line}, "col": 1}}'
    body = f'{{"kind": "CompoundStmt", "range": {{"begin": {place(3)}, "end": {place(5)}}}}}'
    tree = F.concat(F.lit('{"kind": "TranslationUnitDecl", "inner": [{"kind": "FunctionDecl", "name": "unused", "loc": ' + place(1) + "}, "), F.lit('{"kind": "FunctionDecl", "name": "f_'), F.col("n_nationkey").cast("string"), F.lit(f'", "loc": {place(2)}, "range": {{"begin": {place(2)}, "end": {place(5)}}}, "inner": [{body}]}}]}}'))
    return files, files.select("path", "content", F.when(F.col("n_nationkey") % 4 == 0, tree).when(F.col("n_nationkey") % 4 == 2, "{broken").alias("ast"))


_query(
    "parsed_with_fallback",
    lambda r: clang.with_fallback(clang.clang_functions(_trees(r)[1]), functions(_trees(r)[0])).select("path", "fn", "start_line", "body_line", "end_line", "signature", "backend"),
    "SELECT 'src/n' || n_nationkey || '.c' AS path, 'f_' || n_nationkey AS fn, 2 AS start_line, 3 AS body_line, 5 AS end_line, 'static int f_' || n_nationkey || '(int x)' AS signature, CASE WHEN n_nationkey % 4 = 0 THEN 'clang' ELSE 'regex' END AS backend FROM nation",
)


def _flow(read: Callable[[str], DataFrame]) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    dump = F.concat(F.lit("void other(int)\n [B1 (ENTRY)]\n   Succs (1): B0\n\nint ns::f_"), key, F.lit("(int x)\n [B3 (ENTRY)]\n   Succs (1): B2\n\n [B2]\n   1: x\n   T: if [B2.1]\n   Preds (1): B3\n   Succs (2): B1 B0\n\n [B1]\n   1: goto out;\n   Succs (1): B2\n\n [B0 (EXIT)]\n   Preds (1): B2\n"))
    dumps = read("nation").select(F.concat(F.lit("n"), key).alias("path"), dump.alias("cfg"))
    return clang.clang_flow(dumps, read("nation").select(F.concat(F.lit("n"), key).alias("path"), F.concat(F.lit("f_"), key).alias("fn")))[1]


_query(
    "flow_from_dumps",
    lambda r: _flow(r).select("path", "src", "dst", "edge"),
    "SELECT 'n' || n_nationkey AS path, 'f_' || n_nationkey || ':' || s AS src, 'f_' || n_nationkey || ':' || d AS dst, edge FROM nation CROSS JOIN (VALUES ('B3', 'B2', 'control'), ('B2', 'B1', 'control'), ('B2', 'B0', 'return'), ('B1', 'B2', 'goto')) v(s, d, edge)",
)


def _premade(lines: DataFrame, open_: DataFrame, n: int) -> DataFrame:
    """Three of an order's line items as candidates in each round; what they were told makes them better."""
    own = lines.where(F.floor((F.col("l_linenumber") - 1) / 3) == n).select(F.col("l_orderkey").alias("opportunity_id"), F.col("l_linenumber").alias("candidate"), "l_quantity", "l_returnflag")
    return open_.join(own, "opportunity_id").withColumn("l_quantity", F.col("l_quantity") + 5 * F.size("messages"))


def _rounds_sql(rounds: int) -> str:
    out = "f0 AS (SELECT DISTINCT l_orderkey AS id, 0 AS told, 0 AS tried, '' AS messages FROM lineitem)"
    for n in range(rounds):
        out += f""",
c{n} AS (SELECT f.id, l_linenumber AS candidate, l_quantity + 5 * told > 48 AS passed, l_returnflag FROM f{n} f JOIN lineitem ON l_orderkey = id AND (l_linenumber - 1) // 3 = {n}),
s{n} AS (SELECT id, min(candidate) FILTER (WHERE passed) AS chosen, count(*) AS n, string_agg('candidate ' || candidate || ': ' || l_returnflag, ';' ORDER BY candidate, l_returnflag) AS messages FROM c{n} GROUP BY id),
w{n} AS (SELECT f.id, chosen, coalesce(n, 1) AS told, coalesce(s.messages, 'no candidate was made') AS messages, f.tried + coalesce(CASE WHEN chosen IS NULL THEN n ELSE (SELECT count(*) FROM c{n} c WHERE c.id = f.id AND c.candidate <= chosen) END, 0) AS tried FROM f{n} f LEFT JOIN s{n} s USING (id)),
f{n + 1} AS (SELECT id, told, tried, messages FROM w{n} WHERE chosen IS NULL)"""
    solved = " UNION ALL ".join(f"SELECT id, {n} AS round, chosen, tried, '' AS messages FROM w{n} WHERE chosen IS NOT NULL" for n in range(rounds))
    return f"WITH {out} SELECT id AS opportunity_id, round::INTEGER AS round, chosen::INTEGER AS candidate, tried::BIGINT AS tried, messages FROM ({solved} UNION ALL SELECT id, NULL, NULL, tried, messages FROM f{rounds})"


_query(
    "repair_rounds",
    lambda r: repair_rounds(
        r("lineitem").select(F.col("l_orderkey").alias("opportunity_id")), lambda open_, n: _premade(r("lineitem"), open_, n),
        lambda made: made.withColumns({"passed": F.col("l_quantity") > 48, "logs": F.array("l_returnflag")}),
    ).withColumn("messages", F.array_join("messages", ";")),
    _rounds_sql(3),
)
