"""Queries over the generated C corpus, and the SQL that gets the same from the rows that made it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .operators import detect, facts, findings, graph, lines, validate
from .operators.lex import functions
from .shared import materialise
from .sources import clang
from .sources.corpus import generated_corpus, lines_cte

#: The second version of the corpus lacks these rows.
LATER = "event_id % 97 <> 0"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _functions(spark: SparkSession, sf_dir: str, keep: str = "TRUE") -> DataFrame:
    return functions(generated_corpus(spark.read.parquet(f"{sf_dir}/events.parquet"), keep))


def _tables(spark: SparkSession, sf_dir: str, keep: str = "TRUE") -> detect.Tables:
    return detect.Tables.of(_functions(spark, sf_dir, keep))


def _query(name: str, of: Callable[[detect.Tables], DataFrame], sql: str, often: bool = False) -> None:
    """``often``: lines are read by several branches of the plan, so they are parsed once and written."""
    QUERIES[name] = lambda spark, sf_dir: of(_tables(spark, sf_dir).written() if often else _tables(spark, sf_dir))
    SQL[name] = f"WITH {lines_cte()}, {EVENTS_CTE} {sql}"


def _list(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_KIND = "CASE " + " ".join(f"WHEN %s IN ({_list([c for c, k in vocab.EVENT_CALLS.items() if k == kind])}) THEN '{kind}'" for kind in ("alloc", "open", "lock", "free", "close", "unlock")) + " END"
kind_of = lambda call: _KIND.replace("%s", call)
_ASSIGN = r"([A-Za-z_]\w*)\s*=\s*(\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\("
_HINTS = "|".join(vocab.RELEASE_HINTS + vocab.TRANSFER_HINTS)

EVENTS_CTE = rf"""
c0 AS (SELECT *, regexp_extract(stmt, '{_ASSIGN}', 1) AS avar, regexp_extract(stmt, '{_ASSIGN}', 3) AS acall FROM code_lines),
calls AS (SELECT *, unnest(regexp_extract_all(stmt, '\b([A-Za-z_]\w*)\s*\(([^()]*)\)', 1)) AS call, unnest(regexp_extract_all(stmt, '\b([A-Za-z_]\w*)\s*\(([^()]*)\)', 2)) AS args FROM c0),
ev AS (SELECT DISTINCT * FROM (
  SELECT path, fn, line, {kind_of("acall")} AS kind, avar AS variable, acall AS call FROM c0 WHERE {kind_of("acall")} IN ('alloc', 'open', 'lock')
  UNION ALL SELECT path, fn, line, {kind_of("call")}, regexp_extract(args, '[A-Za-z_]\w*'), call FROM calls WHERE call <> acall AND {kind_of("call")} IS NOT NULL AND NOT ({kind_of("call")} IN ('alloc', 'open') AND acall <> ''))),
acq AS (SELECT *, CASE kind WHEN 'alloc' THEN 'free' WHEN 'open' THEN 'close' ELSE 'unlock' END AS wanted FROM ev WHERE kind IN ('alloc', 'open', 'lock')),
handed AS (SELECT DISTINCT k.path, k.fn, k.variable, c.line FROM (SELECT DISTINCT path, fn, variable FROM ev) k JOIN calls c USING (path, fn)
  WHERE regexp_matches(lower(c.call), '{_HINTS}') AND regexp_matches(c.args, '(^|\W)' || k.variable || '($|\W)')
  UNION SELECT k.path, k.fn, k.variable, l.line FROM (SELECT DISTINCT path, fn, variable FROM ev) k JOIN code_lines l USING (path, fn) WHERE regexp_matches(l.stmt, '\breturn\s+' || k.variable || '\s*;')),
gotos AS (SELECT path, fn, line, stmt, target, prev FROM (SELECT *, regexp_extract(stmt, '\bgoto\s+([A-Za-z_]\w*)\s*;', 1) AS target, lag(stmt) OVER (PARTITION BY path, fn ORDER BY line) AS prev FROM code_lines) WHERE target <> ''),
marked AS (SELECT *, CASE WHEN regexp_matches(stmt, '^[A-Za-z_]\w*\s*:') THEN regexp_extract(stmt, '^([A-Za-z_]\w*)', 1) END AS label FROM code_lines),
labels AS (SELECT path, fn, label, max(line) AS line FROM marked WHERE label IS NOT NULL GROUP BY ALL),
inside AS (SELECT path, fn, line, stmt, last_value(label IGNORE NULLS) OVER (PARTITION BY path, fn ORDER BY line) AS label, label IS NOT NULL AS own FROM marked),
blocks AS (SELECT path, fn, line, stmt, label FROM inside WHERE label IS NOT NULL AND NOT own),
clean AS (SELECT *, regexp_extract(stmt, '\b({"|".join(vocab.CLEANUP_CALLS)})\s*\(([^)]*)\)', 1) AS call, regexp_extract(stmt, '\b({"|".join(vocab.CLEANUP_CALLS)})\s*\(([^)]*)\)', 2) AS variable FROM code_lines),
rets AS (SELECT *, max(line) OVER (PARTITION BY path, fn) AS final FROM code_lines WHERE regexp_matches(stmt, '^return\b'))
"""
_OUT = ["path", "fn", "line", "severity", "confidence", "description"]


#: Detectors that read lines or events more than twice.
MANY_BRANCHES = ["missing_release", "double_release", "early_return", "missing_cleanup_on_error", "duplicate_checks", "goto_redundant_error_block", "goto_single_use_label"]


#: The detectors' SQL, without what leads up to it.
DETECTOR_SQL: dict[str, str] = {}


def _found(name: str, sql: str) -> None:
    """A detector as a query, severity as it is before gating."""
    DETECTOR_SQL[name] = f"SELECT DISTINCT path, fn, line::INTEGER AS line, severity, confidence::DOUBLE AS confidence, description FROM ({sql})"
    _query(name, lambda t, d=detect.DETECTORS[name]: d(t).select(*_OUT).distinct(), f"SELECT DISTINCT path, fn, line::INTEGER AS line, severity, confidence::DOUBLE AS confidence, description FROM ({sql})", often=name in MANY_BRANCHES)


_query(
    "function_table",
    lambda t: t.functions.select("path", "fn", "start_line", "body_line", "end_line", "signature"),
    "SELECT path, fn, 3 AS start_line, 3 AS body_line, (max(line) + 1)::INTEGER AS end_line, 'int ' || fn || '(char *p, int x)' AS signature FROM code_lines GROUP BY path, fn",
)
# the signature shares the brace's line, and that line's code is the brace alone
_query("code_lines", lambda t: t.lines.select("path", "fn", "line", "stmt"), "SELECT path, fn, line, stmt FROM code_lines")
_query("statement_classes", lambda t: t.lines.groupBy(lines.statement_class(F.col("stmt")).alias("class")).agg(F.count(F.lit(1)).alias("n")), r"""
SELECT CASE WHEN regexp_matches(stmt, '^return\b') THEN 'return' WHEN regexp_matches(stmt, '\bgoto\s+\w+\s*;') THEN 'goto' WHEN regexp_matches(stmt, '^(if|else)\b') THEN 'branch' WHEN regexp_matches(stmt, '^(for|while|do)\b') THEN 'loop'
  WHEN regexp_matches(stmt, '^switch\b') THEN 'switch' WHEN regexp_matches(stmt, '^\w+\s*:') THEN 'label' ELSE 'other' END AS class, count(*) AS n FROM code_lines GROUP BY ALL""")
_query("resource_events", lambda t: t.events.select("path", "fn", "line", "kind", "variable", "call"), "SELECT path, fn, line, kind, variable, call FROM ev")
_query("flow_events", lambda t: lines.flow_events(lines.statements(t.functions)).select("path", "fn", "line", "kind", "variable"), r"""
SELECT path, fn, line, kind, variable FROM ev WHERE NOT (kind = 'alloc' AND variable = 'p')""")
_query("state_trace", lambda t: detect.state_trace(t.events).select("path", "fn", "line", "kind", "variable", "state_before", "state_after"), """
SELECT path, fn, line, kind, variable, coalesce(lag(state_after) OVER (PARTITION BY path, fn, variable ORDER BY line, kind, call), 'unknown') AS state_before, state_after
FROM (SELECT *, CASE WHEN kind IN ('alloc', 'open', 'lock') THEN 'owned' ELSE 'released' END AS state_after FROM ev)""")
_query("next_release", lambda t: _next_release(t), """
SELECT path, fn, line, kind, variable, coalesce((SELECT min(r.line) FROM ev r WHERE r.path = a.path AND r.fn = a.fn AND r.variable = a.variable AND r.kind = a.wanted AND r.line > a.line), -1) AS release FROM acq a""")


def _next_release(t: detect.Tables) -> DataFrame:
    from .functions.scalars import lookup
    from .operators.asof import next_after

    acquired = t.events.where(F.col("kind").isin(*vocab.RELEASE_OF)).withColumn("wanted", lookup(F.col("kind"), vocab.RELEASE_OF))
    marks = t.events.select(*lines.FN, "variable", F.col("kind").alias("wanted"), "line")
    return next_after(acquired, marks, [*lines.FN, "variable", "wanted"], "line", "release").select("path", "fn", "line", "kind", "variable", F.coalesce("release", F.lit(-1)).alias("release"))


_found("missing_release", """
SELECT path, fn, line, 'high' AS severity, 0.58 AS confidence, 'Resource ' || variable || ' has ' || CASE kind WHEN 'alloc' THEN 'missing free' WHEN 'open' THEN 'missing close' ELSE 'missing unlock' END || ' after ' || kind || '.' AS description
FROM acq a WHERE NOT EXISTS (FROM ev r WHERE r.path = a.path AND r.fn = a.fn AND r.variable = a.variable AND r.kind = a.wanted AND r.line > a.line)
  AND NOT EXISTS (FROM handed h WHERE h.path = a.path AND h.fn = a.fn AND h.variable = a.variable AND h.line > a.line)""")
_found("double_release", r"""
SELECT path, fn, line, 'critical' AS severity, 0.72::DOUBLE + 0.08::DOUBLE AS confidence, 'Resource ' || variable || ': possibly a double ' || CASE kind WHEN 'free' THEN 'free' WHEN 'close' THEN 'close' ELSE 'unlock' END || '.' AS description
FROM (SELECT *, lag(line) OVER (PARTITION BY path, fn, variable, kind ORDER BY line) AS before, CASE kind WHEN 'free' THEN 'alloc' WHEN 'close' THEN 'open' ELSE 'lock' END AS acquire FROM ev WHERE kind IN ('free', 'close', 'unlock')) r
WHERE before IS NOT NULL AND NOT EXISTS (FROM ev x WHERE x.path = r.path AND x.fn = r.fn AND x.variable = r.variable AND x.kind = r.acquire AND x.line > before AND x.line < r.line)
  AND NOT EXISTS (FROM code_lines l WHERE l.path = r.path AND l.fn = r.fn AND l.line > before AND l.line < r.line AND (regexp_matches(l.stmt, '^(return\b|goto |if ?\(|if |else|switch|case |default:|for ?\(|while ?\()')
    OR regexp_matches(replace(l.stmt, ' ', ''), r.variable || '=(NULL|nullptr|0|[A-Za-z_]\w*\()')))""")
_found("early_return", r"""
SELECT a.path, a.fn, r.line, 'high' AS severity, 0.6::DOUBLE + 0.08::DOUBLE AS confidence, 'A return here skips the release of ' || a.variable || '.' AS description
FROM (SELECT a.*, (SELECT min(e.line) FROM ev e WHERE e.path = a.path AND e.fn = a.fn AND e.variable = a.variable AND e.kind = a.wanted AND e.line > a.line) AS release FROM acq a) a JOIN rets r ON r.path = a.path AND r.fn = a.fn AND r.line > a.line
WHERE (release IS NULL AND r.line <> r.final OR r.line < release)
  AND NOT EXISTS (FROM handed h WHERE h.path = a.path AND h.fn = a.fn AND h.variable = a.variable AND h.line > a.line AND h.line < r.line)
  AND NOT EXISTS (FROM gotos g WHERE g.path = a.path AND g.fn = a.fn AND g.line > a.line AND g.line < r.line AND regexp_matches(lower(g.target), 'out|cleanup|err|fail'))""")
_found("goto_cleanup_consolidation", r"""
SELECT path, fn, line, 'high' AS severity, 0.88 AS confidence, 'Several returns do the same cleanup; one cleanup label could serve them all.' AS description FROM (
  WITH n AS (SELECT *, row_number() OVER w AS i, regexp_matches(stmt, '^return\b') AS ret, coalesce(sum(regexp_matches(stmt, '^return\b')::INT) OVER (PARTITION BY path, fn ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM clean WINDOW w AS (PARTITION BY path, fn ORDER BY line)),
  b AS (SELECT r.path, r.fn, r.line, c.stmt FROM n r JOIN n c ON c.path = r.path AND c.fn = r.fn AND c.part = r.part AND c.i BETWEEN r.i - 8 AND r.i - 1 WHERE r.ret AND c.call <> '' AND NOT c.ret GROUP BY ALL),
  k AS (SELECT path, fn, count(DISTINCT line) AS blocks, min(line) AS line FROM b GROUP BY ALL)
  SELECT DISTINCT k.path, k.fn, k.line FROM k JOIN (SELECT path, fn, stmt, count(*) AS n FROM b GROUP BY ALL) s ON s.path = k.path AND s.fn = k.fn AND s.n = k.blocks WHERE k.blocks >= 2)""")
_found("goto_redundant_cleanup", """
SELECT g.path, g.fn, g.line, 'medium' AS severity, 0.78 AS confidence, 'What is released before goto ' || g.target || ' is released again at its label.' AS description FROM gotos g
WHERE EXISTS (FROM clean c JOIN clean d ON d.path = c.path AND d.fn = c.fn AND d.stmt = c.stmt JOIN blocks b ON b.path = d.path AND b.fn = d.fn AND b.line = d.line
  WHERE c.path = g.path AND c.fn = g.fn AND c.call <> '' AND c.line BETWEEN g.line - 6 AND g.line - 1 AND b.label = g.target)""")
_found("goto_redundant_error_block", """
SELECT l.path, l.fn, l.line, 'high' AS severity, 0.82 AS confidence, 'The block at label ' || l.label || ' makes the same cleanup call twice.' AS description FROM labels l
WHERE EXISTS (FROM gotos g WHERE g.path = l.path AND g.fn = l.fn) AND (regexp_matches(lower(l.label), 'cleanup|out|error|err|fail|failed') OR EXISTS (FROM gotos g WHERE g.path = l.path AND g.fn = l.fn AND g.target = l.label))
  AND EXISTS (SELECT 1 FROM blocks b JOIN clean c ON c.path = b.path AND c.fn = b.fn AND c.line = b.line WHERE b.path = l.path AND b.fn = l.fn AND b.label = l.label AND c.call <> '' GROUP BY c.call, c.variable HAVING count(*) >= 2)""")
_found("goto_duplicated_error_handling", """
SELECT path, fn, min(line) AS line, 'medium' AS severity, 0.72 AS confidence, 'The same statement stands before several gotos to ' || target || '.' AS description FROM gotos WHERE prev IS NOT NULL GROUP BY path, fn, target, prev HAVING count(*) >= 2""")
_found("goto_chain", r"""
SELECT l.path, l.fn, l.line, 'medium' AS severity, 0.86 AS confidence, 'Label ' || l.label || ' does nothing but jump to ' || g.target || '.' AS description
FROM labels l JOIN (SELECT path, fn, label, min(line) AS line FROM blocks GROUP BY ALL) b USING (path, fn, label) JOIN gotos g ON g.path = b.path AND g.fn = b.fn AND g.line = b.line""")
_found("goto_single_use_label", """
SELECT g.path, g.fn, g.line, 'low' AS severity, 0.62 AS confidence, 'Label ' || g.target || ' has one goto; plain control flow could take its place.' AS description
FROM (SELECT path, fn, target, min(line) AS line FROM gotos GROUP BY ALL HAVING count(*) = 1) g JOIN labels l ON l.path = g.path AND l.fn = g.fn AND l.label = g.target
WHERE regexp_matches(lower(g.target), 'cleanup|out|err|fail') OR (SELECT count(*) FROM blocks b WHERE b.path = g.path AND b.fn = g.fn AND b.label = g.target) <= 6""")
_CHECKS = r"""
  WITH k AS (SELECT path, fn, line, stmt, CASE WHEN stmt = 'if (!p)' THEN 'p' WHEN stmt = 'if (!q)' THEN 'q' WHEN stmt = 'if (n < len)' THEN 'n' WHEN stmt = 'if (rc != 0)' THEN 'rc' WHEN stmt = 'if (hdr_type == 7)' THEN 'hdr_type' END AS variable,
    CASE WHEN stmt LIKE 'if (!_)' THEN 'null_check' WHEN stmt LIKE '%<%' THEN 'bounds_check' WHEN stmt LIKE '%rc%' THEN 'status_check' ELSE 'sanity_check' END AS chk FROM code_lines WHERE stmt IN ('if (!p)', 'if (!q)', 'if (n < len)', 'if (rc != 0)', 'if (hdr_type == 7)')),
  a AS (SELECT *, first_value(line) OVER w AS first, row_number() OVER w AS i FROM k WINDOW w AS (PARTITION BY path, fn, stmt ORDER BY line)),
  s AS (SELECT a.*, NOT EXISTS (FROM calls c WHERE c.path = a.path AND c.fn = a.fn AND c.line > first AND c.line < a.line AND c.call NOT IN ('if', 'for', 'while', 'switch', 'return', 'sizeof'))
    AND NOT EXISTS (FROM code_lines l WHERE l.path = a.path AND l.fn = a.fn AND l.line > first AND l.line < a.line AND regexp_matches(l.stmt, '\b' || a.variable || '\s*(=|\+=|\+\+)')) AS safe FROM a WHERE i > 1)"""
_found("duplicate_checks", f"""
{_CHECKS} SELECT path, fn, line, CASE WHEN safe THEN 'low' ELSE 'medium' END AS severity, CASE WHEN safe THEN 0.78 ELSE 0.56 END AS confidence, 'Repeated ' || chk || ' over ' || variable || ', first made at line ' || first || '.' AS description FROM s""")
_found("repeated_validation", f"""
{_CHECKS} SELECT path, fn, line, 'medium' AS severity, 0.58 AS confidence, 'The same check was first made at line ' || first || '.' AS description FROM s""")
_found("after_jump", r"""
  WITH h AS (SELECT *, regexp_matches(stmt, '^if\s*\(') AS head FROM marked),
  j AS (SELECT *, CASE WHEN label IS NULL AND NOT head AND NOT coalesce(lag(head) OVER w, false) THEN CASE WHEN regexp_matches(stmt, '\bgoto\s+\w+\s*;') THEN 'goto' WHEN regexp_matches(stmt, '^return\b') THEN 'return' END END AS jump FROM h WINDOW w AS (PARTITION BY path, fn ORDER BY line)),
  f AS (SELECT *, CASE WHEN jump IS NULL OR coalesce(lag(jump) OVER w, '') = '' OR label IS NOT NULL THEN 1 ELSE 0 END AS free FROM j WHERE NOT head WINDOW w AS (PARTITION BY path, fn ORDER BY line)),
  r AS (SELECT *, sum(free) OVER (PARTITION BY path, fn ORDER BY line) AS run FROM f),
  p AS (SELECT *, row_number() OVER (PARTITION BY path, fn, run ORDER BY line) % 2 = 1 AS odd FROM r)
SELECT path, fn, line, 'high' AS severity, 0.88 AS confidence, 'Nothing reaches what follows this ' || after || '.' AS description
FROM (SELECT *, lag(CASE WHEN odd THEN jump END) OVER (PARTITION BY path, fn ORDER BY line) AS after FROM p) WHERE after IS NOT NULL AND label IS NULL""")
_found("unreached_label", """
SELECT l.path, l.fn, l.line, 'medium' AS severity, 0.66 AS confidence, 'Label ' || l.label || ' is the target of no goto.' AS description FROM labels l WHERE NOT EXISTS (FROM gotos g WHERE g.path = l.path AND g.fn = l.fn AND g.target = l.label)""")
_found("constant_branch", "SELECT path, fn, line, 'medium' AS severity, 0.92 AS confidence, 'The condition is always 0.' AS description FROM code_lines WHERE stmt = 'if (0)'")
_found("unchecked_return", r"""
SELECT path, fn, line, 'high' AS severity, 0.82 AS confidence, 'The value of ' || acall || ' assigned to ' || avar || ' is used unchecked.' AS description
FROM (SELECT *, row_number() OVER (PARTITION BY path, fn ORDER BY line) AS i FROM c0) a WHERE acall IN ('malloc', 'fopen')
  AND coalesce((SELECT min(i) FROM (SELECT *, row_number() OVER (PARTITION BY path, fn ORDER BY line) AS i FROM code_lines) l WHERE l.path = a.path AND l.fn = a.fn AND l.i BETWEEN a.i + 1 AND a.i + 5 AND regexp_matches(l.stmt, '\bif\s*\(\s*!\s*' || avar || '\b')), 1000000)
    > coalesce((SELECT min(i) FROM (SELECT *, row_number() OVER (PARTITION BY path, fn ORDER BY line) AS i FROM code_lines) l WHERE l.path = a.path AND l.fn = a.fn AND l.i BETWEEN a.i + 1 AND a.i + 5 AND regexp_matches(l.stmt, '\b' || avar || '\s*=')), 999999)""")
_found("unsafe_call", "SELECT path, fn, line, 'high' AS severity, 0.9 AS confidence, 'A call of the unsafe function strcpy.' AS description FROM code_lines WHERE stmt = 'strcpy(d, s);'")
_found("repeated_cleanup", """
SELECT path, fn, line, 'medium' AS severity, 0.78 AS confidence, 'Cleanup for ' || variable || ' via ' || call || ' repeats line ' || first || '.' AS description
FROM (SELECT *, first_value(line) OVER w AS first, row_number() OVER w AS i FROM clean WHERE call <> '' WINDOW w AS (PARTITION BY path, fn, call, variable ORDER BY line)) WHERE i > 1""")
_found("unreachable_cleanup", """
SELECT l.path, l.fn, l.line, 'high' AS severity, 0.8 AS confidence, 'No goto leads to the cleanup label ' || l.label || '.' AS description FROM labels l WHERE regexp_matches(lower(l.label), 'cleanup|out|err|fail') AND NOT EXISTS (FROM gotos g WHERE g.path = l.path AND g.fn = l.fn AND g.target = l.label)""")
_found("missing_cleanup_on_error", r"""
SELECT a.path, a.fn, r.line, 'high' AS severity, 0.84 AS confidence, 'An error return leaves behind ' || a.variable || ' acquired at line ' || a.line || '.' AS description
FROM acq a JOIN rets r ON r.path = a.path AND r.fn = a.fn AND r.line > a.line WHERE regexp_matches(lower(r.stmt), '-1|null|false|err')
  AND NOT EXISTS (FROM ev e WHERE e.path = a.path AND e.fn = a.fn AND e.variable = a.variable AND e.kind IN ('free', 'close', 'unlock') AND e.line > a.line AND e.line < r.line)
  AND NOT EXISTS (FROM gotos g WHERE g.path = a.path AND g.fn = a.fn AND g.line > a.line AND g.line < r.line AND regexp_matches(lower(g.target), 'cleanup|out|err|fail'))""")
_found("inconsistent_errors", r"""
SELECT path, fn, 3 AS line, 'medium' AS severity, 0.65 AS confidence, 'Errors are returned in more than one way.' AS description FROM rets GROUP BY path, fn HAVING count(DISTINCT stmt) > 1""")
_found("poor_api", "SELECT path, fn, line, 'medium' AS severity, 0.68 AS confidence, 'atoi can''t tell an error from 0; strtol can.' AS description FROM code_lines WHERE stmt = 'n = atoi(s);'")
_query("call_edges", lambda t: graph.call_edges(t.functions), "SELECT DISTINCT path, fn AS src, call AS dst FROM calls WHERE call NOT IN ('if', 'return')")
_query("control_edges", lambda t: graph.control_edges(t.functions).select("path", "src", "dst", "edge"), r"""
, s AS (SELECT path, fn, line, trim(unnest(string_split(regexp_replace(stmt, '^(\w+:)\s*', '\1'), '|'))) AS stmt FROM code_lines),
b AS (SELECT *, row_number() OVER w AS k, regexp_extract(stmt, '\bgoto\s+(\w+)\s*;', 1) AS target, regexp_matches(stmt, '^return\b') AS ret FROM s WINDOW w AS (PARTITION BY path, fn ORDER BY line)),
n AS (SELECT *, fn || ':bb' || k AS block, fn || ':exit' AS out, lead(fn || ':bb' || k, 1) OVER w AS next, lead(fn || ':bb' || k, 2) OVER w AS after FROM b WINDOW w AS (PARTITION BY path, fn ORDER BY k))
SELECT DISTINCT * FROM (
  SELECT path, fn || ':entry' AS src, block AS dst, 'control' AS edge FROM n WHERE k = 1
  UNION ALL SELECT path, block, out, 'return' FROM n WHERE ret
  UNION ALL SELECT path, block, coalesce(next, out), 'control' FROM n WHERE NOT ret AND target = ''
  UNION ALL SELECT path, block, coalesce(after, out), 'control' FROM n WHERE regexp_matches(stmt, '^if\b') AND next IS NOT NULL
  UNION ALL SELECT n.path, n.block, l.block, 'goto' FROM n JOIN n l ON l.path = n.path AND l.fn = n.fn AND l.stmt = n.target || ':' WHERE n.target <> '')""")
_query("function_summaries", lambda t: graph.summaries(t.functions, t.events).select("path", "fn", "resources", "gotos"), """
SELECT f.path, f.fn, coalesce((SELECT string_agg(variable, ', ' ORDER BY variable) FROM (SELECT DISTINCT variable FROM ev e WHERE e.path = f.path AND e.fn = f.fn)), 'none') AS resources, (SELECT count(DISTINCT target) FROM gotos g WHERE g.path = f.path AND g.fn = f.fn)::INTEGER AS gotos
FROM (SELECT DISTINCT path, fn FROM code_lines) f""")
_query("assigned_variables", lambda t: facts.definitions(t.functions).select("path", "fn", "variable", "line"), r"""
SELECT path, fn, regexp_extract(stmt, '^([a-z]\w*)\s*(=|\+\+)', 1) AS variable, line FROM code_lines WHERE regexp_matches(stmt, '^[a-z]\w*\s*(=|\+\+)') AND NOT regexp_matches(stmt, '^(if|return|goto)\b')
UNION ALL SELECT path, fn, regexp_extract(stmt, '^[a-z]\w* = ([A-Za-z_]\w*)[(;]', 1) AS variable, line FROM code_lines WHERE regexp_matches(stmt, '^[a-z]\w* = [A-Za-z_]\w*[(;]')""")
_query("code_near_unsafe_calls", lambda t: lines.nearby(t.lines, detect.unsafe_call(t).select(*lines.FN, "line"), 2).select("path", "fn", "line", "snippet"), r"""
SELECT a.path, a.fn, a.line, string_agg(b.line || ': ' || b.stmt, chr(10) ORDER BY b.line) AS snippet FROM code_lines a JOIN code_lines b ON b.path = a.path AND b.fn = a.fn AND b.line BETWEEN a.line - 2 AND a.line + 2 WHERE a.stmt = 'strcpy(d, s);' GROUP BY a.path, a.fn, a.line""")


_query("finding_clusters", lambda t: findings.clustered(findings.deduplicated(findings.enriched(detect.early_return(t).withColumn("detector_rank", F.lit(0))))).select("path", "fn", "resource", "pattern", "line", "severity", "cluster_size"), rf"""
SELECT path, fn, variable AS resource, CASE kind WHEN 'alloc' THEN 'allocation followed by early return' WHEN 'open' THEN 'open followed by early return' ELSE 'lock followed by early return' END AS pattern, min(line)::INTEGER AS line, 'high' AS severity, count(DISTINCT line)::INTEGER AS cluster_size FROM (
  SELECT a.path, a.fn, a.variable, a.kind, r.line FROM (SELECT a.*, (SELECT min(e.line) FROM ev e WHERE e.path = a.path AND e.fn = a.fn AND e.variable = a.variable AND e.kind = a.wanted AND e.line > a.line) AS release FROM acq a) a JOIN rets r ON r.path = a.path AND r.fn = a.fn AND r.line > a.line
  WHERE (release IS NULL AND r.line <> r.final OR r.line < release)
    AND NOT EXISTS (FROM handed h WHERE h.path = a.path AND h.fn = a.fn AND h.variable = a.variable AND h.line > a.line AND h.line < r.line)
    AND NOT EXISTS (FROM gotos g WHERE g.path = a.path AND g.fn = a.fn AND g.line > a.line AND g.line < r.line AND regexp_matches(lower(g.target), 'out|cleanup|err|fail'))) GROUP BY ALL""", often=True)
_query("gated_by_path", lambda t: findings.weighed_by_path(findings.enriched(detect.unsafe_call(t).withColumn("detector_rank", F.lit(0)))).groupBy("severity", "confidence", "evidence", "verdict").agg(F.count(F.lit(1)).alias("n")), """
SELECT CASE k WHEN 0 THEN 'medium' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'high' END AS severity, CASE k WHEN 0 THEN 0.72 WHEN 1 THEN 0.675 WHEN 2 THEN 0.585 ELSE 0.9 END::DOUBLE AS confidence,
  CASE WHEN k < 3 THEN 'medium' ELSE 'high' END AS evidence, CASE k WHEN 0 THEN 'likely' WHEN 1 THEN 'likely' WHEN 2 THEN 'unclear' ELSE 'true_positive' END AS verdict, count(*) AS n
FROM (SELECT CASE WHEN path LIKE 'tests/%' THEN 0 WHEN path LIKE 'third_party/%' THEN 1 WHEN path LIKE '%generated%' THEN 2 ELSE 3 END AS k FROM code_lines WHERE stmt = 'strcpy(d, s);') GROUP BY ALL""")


def _with_provenance(t: detect.Tables) -> detect.Tables:
    """The tables as if a compiler had parsed every third user's file, and had given the control flow of every second one's function."""
    user = F.regexp_extract("fn", r"\d+$", 0).cast("long")
    both = clang.with_fallback(t.functions.where(user % 3 == 0), t.functions)
    flow = t.functions.where(user % 2 == 0).select("fn", F.concat("fn", F.lit(":B2")).alias("block"), F.lit("<entry>").alias("stmt"))
    return detect.Tables.of(detect.with_flow(both, flow))


def _provenance_scores(t: detect.Tables) -> DataFrame:
    t = _with_provenance(detect.Tables.of(materialise(t.functions, "functions"))).keep()
    found = detect.double_release(t).unionByName(detect.missing_release(t))
    return t.finish(found.select("path", "fn", "line", "confidence").distinct(), "scores")


_query(
    "scores_by_provenance",
    _provenance_scores,
    f"""SELECT DISTINCT path, fn, line, least(base + CASE WHEN u % 3 = 0 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN u % 2 = 0 THEN 0.06::DOUBLE ELSE 0 END, 1.0::DOUBLE) AS confidence FROM (
  SELECT path, fn, line, regexp_extract(fn, '[0-9]+$')::BIGINT AS u, CASE WHEN description LIKE '%possibly a%' THEN 0.72::DOUBLE + 0.08::DOUBLE ELSE 0.58::DOUBLE END AS base FROM (({DETECTOR_SQL["missing_release"]}) UNION ALL ({DETECTOR_SQL["double_release"]})))""",
)


def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan: every detector, scored, clustered, weighed and ranked."""
    t = _tables(spark, sf_dir).keep()
    reported = findings.weighed_by_path(findings.clustered(findings.deduplicated(findings.enriched(detect.found(t)))))
    return findings.ranked(t.finish(reported, "findings")).select("path", "fn", "line", "kind", "severity", "confidence", "evidence", "verdict", "pattern", "description", "cluster_size", "id")


QUERIES["scan_report"] = scan_report
QUERIES["semantic_changes"] = lambda spark, sf_dir: validate.semantic_issues(_functions(spark, sf_dir), _functions(spark, sf_dir, LATER))
SQL["semantic_changes"] = rf"""WITH {lines_cte()}, {lines_cte(LATER, "_b")},
a AS (SELECT path, fn, list(stmt ORDER BY line) AS r FROM (SELECT path, fn, stmt, min(line) AS line FROM code_lines WHERE stmt LIKE 'return%' GROUP BY ALL) GROUP BY ALL),
b AS (SELECT path, fn, list(stmt ORDER BY line) AS r FROM (SELECT path, fn, stmt, min(line) AS line FROM code_lines_b WHERE stmt LIKE 'return%' GROUP BY ALL) GROUP BY ALL),
c AS (SELECT path, fn, list(call ORDER BY line) AS v FROM (SELECT path, fn, regexp_extract(stmt, '(fopen|fclose|free|pthread_mutex_unlock)\(', 1) AS call, min(line) AS line FROM code_lines GROUP BY ALL HAVING call <> '') GROUP BY ALL),
d AS (SELECT path, fn, list(call ORDER BY line) AS v FROM (SELECT path, fn, regexp_extract(stmt, '(fopen|fclose|free|pthread_mutex_unlock)\(', 1) AS call, min(line) AS line FROM code_lines_b GROUP BY ALL HAVING call <> '') GROUP BY ALL)
SELECT path, fn, 'return statement forms changed' AS issue FROM a JOIN b USING (path, fn) WHERE a.r <> b.r
UNION ALL SELECT path, fn, 'externally visible calls changed' FROM (SELECT DISTINCT path, fn FROM code_lines_b) x LEFT JOIN c USING (path, fn) LEFT JOIN d USING (path, fn) WHERE coalesce(c.v, []) <> coalesce(d.v, [])
UNION ALL SELECT path, fn, 'function removed' FROM (SELECT DISTINCT path, fn FROM code_lines) x WHERE NOT EXISTS (FROM code_lines_b y WHERE y.path = x.path AND y.fn = x.fn)"""
QUERIES["resource_issues"] = lambda spark, sf_dir: validate.resource_issues(_tables(spark, sf_dir).written())
QUERIES["resource_regressions"] = lambda spark, sf_dir: validate.new_issues(validate.resource_issues(_tables(spark, sf_dir).written()), validate.resource_issues(_tables(spark, sf_dir, LATER).written()))
QUERIES["security_changes"] = lambda spark, sf_dir: validate.security_issues(_tables(spark, sf_dir).written(), _tables(spark, sf_dir, LATER).written())

_ISSUES_CTE = r"""
n AS (SELECT a.*, (SELECT min(e.line) FROM ev e WHERE e.path = a.path AND e.fn = a.fn AND e.variable = a.variable AND e.kind = a.wanted AND e.line > a.line) AS release FROM acq a),
issues AS (SELECT path, fn, variable || ' acquired via ' || kind || ' at line ' || line || ' lacks matching ' || wanted AS issue FROM n WHERE release IS NULL
UNION ALL SELECT q.path, q.fn, 'early return at line ' || r.line || ' may bypass cleanup of ' || variable || ' acquired at line ' || q.line || ': ' || r.stmt FROM n q JOIN rets r ON r.path = q.path AND r.fn = q.fn AND r.line > q.line WHERE kind IN ('alloc', 'lock') AND (release IS NULL AND r.line <> r.final OR r.line < release)
UNION ALL SELECT path, fn, 'obvious double ' || kind || ' of ' || variable || ' at lines ' || string_agg(line::VARCHAR, ', ' ORDER BY line) FROM ev WHERE kind IN ('free', 'close', 'unlock') GROUP BY path, fn, kind, variable HAVING count(*) > 1)
"""


def _version(keep: str, suffix: str) -> str:
    """All CTEs up to issues, for the rows that ``keep`` lets through, the tables' names with a suffix."""
    text = lines_cte(keep, suffix) + ", " + EVENTS_CTE + ", " + _ISSUES_CTE
    tables = ["c0", "calls", "ev", "acq", "handed", "gotos", "marked", "labels", "inside", "blocks", "clean", "rets", "issues", "n", "code_lines"]
    for t in tables:
        text = re.sub(rf"(?m)(FROM |JOIN |^){t}(?=[ ),\n])", rf"\g<1>{t}{suffix}", text)
    return text


SQL["resource_issues"] = f"WITH {_version('TRUE', '')} SELECT * FROM issues"
SQL["resource_regressions"] = f"WITH {_version('TRUE', '')}, {_version(LATER, '_b')} SELECT * FROM issues_b WHERE (path, fn, issue) NOT IN (SELECT path, fn, issue FROM issues)"


_COUNTS_CTE = r"""
c1 AS (SELECT *, row_number() OVER (PARTITION BY path, fn ORDER BY line) AS i FROM c0),
unchecked AS (SELECT a.path, a.fn, a.line FROM c1 a WHERE acall IN ('malloc', 'fopen')
  AND coalesce((SELECT min(l.i) FROM c1 l WHERE l.path = a.path AND l.fn = a.fn AND l.i BETWEEN a.i + 1 AND a.i + 5 AND regexp_matches(l.stmt, '\bif\s*\(\s*!\s*' || a.avar || '\b')), 1000000)
    > coalesce((SELECT min(l.i) FROM c1 l WHERE l.path = a.path AND l.fn = a.fn AND l.i BETWEEN a.i + 1 AND a.i + 5 AND regexp_matches(l.stmt, '\b' || a.avar || '\s*=')), 999999)),
bypassed AS (SELECT a.path, a.fn, a.line FROM (SELECT DISTINCT path, fn, variable, line FROM acq) a JOIN rets r ON r.path = a.path AND r.fn = a.fn AND r.line > a.line WHERE regexp_matches(lower(r.stmt), '-1|null|false|err')
  AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.path = a.path AND e.fn = a.fn AND e.variable = a.variable AND e.kind IN ('free', 'close', 'unlock') AND e.line > a.line AND e.line < r.line)
  AND NOT EXISTS (SELECT 1 FROM gotos g WHERE g.path = a.path AND g.fn = a.fn AND g.line > a.line AND g.line < r.line AND regexp_matches(lower(g.target), 'cleanup|out|err|fail'))),
tallies AS (SELECT path, fn, count(*) FILTER (WHERE stmt IN ('if (!p)', 'if (!q)')) AS null_checks, count(*) FILTER (WHERE stmt = 'if (n < len)') AS bounds_checks, max((stmt = 'strcpy(d, s);')::INTEGER) AS unsafe FROM code_lines GROUP BY path, fn),
counts AS (SELECT t.*, (SELECT count(*) FROM ev e WHERE e.path = t.path AND e.fn = t.fn AND e.kind IN ('free', 'close', 'unlock')) AS releases,
  (SELECT count(*) FROM unchecked u WHERE u.path = t.path AND u.fn = t.fn) AS unchecked_return_value, (SELECT count(*) FROM bypassed b WHERE b.path = t.path AND b.fn = t.fn) AS missing_cleanup_on_error_path FROM tallies t)
"""


def _counted(keep: str, suffix: str) -> str:
    text = _version(keep, suffix) + ", " + re.sub(r"(?m)(FROM |JOIN |^)(c0|c1|ev|acq|rets|gotos|code_lines)(?=[ ),\n])", rf"\g<1>\g<2>{suffix}", _COUNTS_CTE)
    for t in ("c1", "unchecked", "bypassed", "tallies", "counts"):
        text = re.sub(rf"(?m)(FROM |JOIN |^){t}(?=[ ),\n])", rf"\g<1>{t}{suffix}", text)
    return text


_PAIRED = "SELECT a.path, a.fn, unnest([" + ", ".join(
    [f"CASE WHEN b.{c} < a.{c} THEN '{c} decreased from ' || a.{c} || ' to ' || b.{c} END" for c in ("null_checks", "bounds_checks", "releases")]
    + [f"CASE WHEN b.{c} > a.{c} THEN '{c} increased from ' || a.{c} || ' to ' || b.{c} END" for c in ("unchecked_return_value", "missing_cleanup_on_error_path")]
    + ["CASE WHEN b.unsafe > a.unsafe THEN 'unsafe API usage increased' END"]
) + "]) AS issue FROM counts a JOIN counts_b b ON b.path = a.path AND b.fn = a.fn"
SQL["security_changes"] = f"WITH {_counted('TRUE', '')}, {_counted(LATER, '_b')}, paired AS ({_PAIRED}) SELECT * FROM paired WHERE issue IS NOT NULL"
