"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .chat import format_pairs, stale_pairs
from .chat import written as spans_written
from .codes import encode, with_label_errors
from .decontaminate import find_passages
from .html_text import extract_text
from .jaccard import link_counts, similar_sets
from .media import media_columns
from .mixing import allocate, in_order, measured
from .pii import PATTERNS, find_pii, written
from .quality import fit, held_out, score_documents
from .repeats import find_runs
from .storage import materialise, table
from .tokens import count_tokens, model_path
from .urls import RULES, alias_edges, judge_urls


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("pii_base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("pii_base")), 256).alias("base_sha256"), written(F.col("pii_spans")).alias("spans"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialise(measured(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text"), "sizes")
    return in_order(allocate(sizes, size="size")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_passages(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("benchmark_hits").alias("hit"))
    return found.select("doc_id", F.col("hit.item").alias("item_id"), "hit.cosine", "hit.overlap")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op6_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(table(spark, sf_dir, "documents"), width=4, percent=85)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), with_media=False)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), model_path("piece_bpe_32k.model"))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_pairs(stale_pairs(table(spark, sf_dir, "conversations")))
    return made.withColumns({c: spans_written(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages.select("page_id", "url"), alias_edges(pages)).select("page_id", "host", "path", "rule", "verdict")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def _repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where crc32(doc_id) is a multiple of 10, the words from place a on are a period of p words over and over."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", crc.alias("h"), F.floor(crc / 10).alias("g"), F.when(crc % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).alias("words"))
    sized = words.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rest = F.col("n") - F.col("a")
    p = 1 + F.floor(rest / (3 + F.col("g") % 8))
    piece = F.slice("words", F.col("a") + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(piece, F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return sized.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(_repeated_tails(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    start, length, period = -F.col("best.before"), F.col("best.length"), -F.col("best.shorter")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    digits = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    final = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_label_errors(coded).select("vec_id", digits.alias("code"), "error", "label_error", F.lit(final).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_main_text": op2_main_text,
    "op3_mix_sources": op3_mix_sources,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard_join": op6_jaccard_join,
    "op6_link_counts": op6_link_counts,
    "op7_media_columns": op7_media_columns,
    "op8_token_counts": op8_token_counts,
    "op9_preferences": op9_preferences,
    "op10_url_filter": op10_url_filter,
    "op11_toxicity": op11_toxicity,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {}

SQL["op3_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT *, (n % 3 + 1)::BIGINT AS weight, CASE WHEN n % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS slope FROM s),
r AS (SELECT *, sum(source_size) OVER ()::BIGINT - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS remaining,
             sum(weight) OVER (ORDER BY source_size / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS share FROM w),
l AS (SELECT *, CASE WHEN remaining * weight <= 3 * source_size * share THEN remaining::DOUBLE / share::DOUBLE END AS level FROM r),
f AS (SELECT *, count(level) OVER (ORDER BY source_size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached,
             first_value(level IGNORE NULLS) OVER (ORDER BY source_size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS common FROM l),
t AS (SELECT source, source_size, slope, CASE WHEN reached = 0 THEN (3 * source_size)::DOUBLE ELSE least(common * weight, (3 * source_size)::DOUBLE) END AS target FROM f),
g AS (SELECT *, floor(target)::BIGINT AS goal FROM t),
p AS (SELECT d.doc_id, d.source, d.size, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done FROM d),
a AS (SELECT p.*, g.source_size, g.target, g.goal, g.slope, CASE WHEN g.source_size > 0 THEN g.goal // g.source_size ELSE 0 END AS whole FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, (whole * size + greatest(0, least(goal - whole * source_size - done, size)))::BIGINT AS taken FROM a)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN ((slope - 1.0::DOUBLE) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * ((done::DOUBLE + least(size, taken)::DOUBLE / 2.0::DOUBLE) / goal::DOUBLE))) / (2.0::DOUBLE * slope) END AS position
FROM k
"""


def _rules_sql(host: str, path: str, what: str) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r.name), r.verdict != "allow"))
    cases = " ".join(f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{r.name if what == 'rule' else r.verdict}'" for r in ordered)
    return f"CASE {cases} END"


SQL["op10_url_filter"] = rf"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM u),
q AS (SELECT page_id, url, html, coalesce(host, '') AS host, coalesce(path, '') AS path, coalesce(tail, '') AS tail FROM h),
clean AS (SELECT url, host, path, tail, regexp_replace(html, '(?is)<!--.*?(-->|$)|<(script|style|template|noscript)\b.*?</(script|style|template|noscript)\s*>', ' ', 'g') AS html FROM q WHERE host <> ''),
links AS (SELECT host, path, tail, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1)))) AS raw FROM clean),
made AS (SELECT host || tail AS src, host, path, tail, replace(replace(replace(replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&#39;', chr(39)), '&#x27;', chr(39)), '&#38;', '&'), '&#x26;', '&'), '&amp;', '&') AS raw,
                regexp_extract(path, '^(.*/)?') AS folder FROM links WHERE raw <> ''),
plain AS (SELECT src, CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN raw WHEN starts_with(raw, '//') THEN 'x:' || raw WHEN starts_with(raw, '/') THEN 'x://' || host || raw
    WHEN starts_with(raw, '?') THEN 'x://' || host || path || raw WHEN starts_with(raw, '#') THEN 'x://' || host || tail
    ELSE 'x://' || host || CASE WHEN folder <> '' THEN folder ELSE '/' END || raw END AS dst FROM made),
parts AS (SELECT src, regexp_extract(r, '^[^/?#]*') AS own, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS p, regexp_extract(r, '^[^?#]*([^#]*)', 1) AS query FROM (SELECT src, substr(dst, position('://' IN dst) + 3) AS r FROM plain)),
full_url AS (SELECT src, 'x://' || own || CASE WHEN contains(p, '/.') THEN list_reduce(list_prepend('', string_split(p, '/')[2:]), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN x = '.' THEN a ELSE a || '/' || x END)
    || CASE WHEN string_split(p, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END ELSE p END || query AS dst FROM parts),
rest AS (SELECT src, substr(dst, position('://' IN dst) + 3) AS rest FROM full_url),
e AS (SELECT DISTINCT src, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS dst FROM rest WHERE regexp_extract(rest, '^[^/?#]*') <> ''),
both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
nodes AS (SELECT DISTINCT src AS node, regexp_extract(src, '^[^/?#]*') AS host, regexp_extract(src, '^[^/?#]*([^?#]*)', 1) AS path FROM both_ways),
caught(node) AS (SELECT node FROM nodes WHERE {_rules_sql("host", "path", "verdict")} = 'block' UNION SELECT b.dst FROM caught c JOIN both_ways b ON b.src = c.node)
SELECT page_id, host, path, {_rules_sql("host", "path", "rule")} AS rule,
       coalesce({_rules_sql("host", "path", "verdict")}, CASE WHEN host <> '' AND host || tail IN (SELECT node FROM caught) THEN 'block' ELSE 'allow' END) AS verdict
FROM q
"""

SQL["op6_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 3), ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, reached) AS (SELECT x, y FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.reached)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""

SQL["op9_preferences"] = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
s AS (SELECT t.conv_id, max_by(text, (turn, text)) AS stale FROM t JOIN l USING (conv_id) WHERE role = 'assistant' AND turn < last GROUP BY t.conv_id),
u AS (SELECT t.*, last, '<|' || role || '|>' || chr(10) AS head, CASE WHEN turn = last AND role = 'assistant' THEN coalesce(stale, '') ELSE text END AS other
      FROM t JOIN l USING (conv_id) LEFT JOIN s USING (conv_id) WHERE turn <= last),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, max(CASE WHEN other <> text THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS differs FROM u)
SELECT conv_id, sum(1 - differs)::INTEGER AS n_common,
       coalesce(string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY pos) FILTER (WHERE differs = 0), '') AS prompt,
       coalesce(string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY pos) FILTER (WHERE differs = 1), '') AS chosen,
       coalesce(string_agg(head || other || '<|end|>' || chr(10), '' ORDER BY pos) FILTER (WHERE differs = 1), '') AS rejected,
       coalesce(max(length(head) || ':' || (length(head) + length(text) + 7)) FILTER (WHERE differs = 1), '') AS chosen_spans,
       coalesce(max(length(head) || ':' || (length(head) + length(other) + 7)) FILTER (WHERE differs = 1), '') AS rejected_spans
FROM n GROUP BY conv_id
"""


def _round_sql(n: int) -> str:
    """Assignment ``a{n}`` by the codebooks ``b{n}``, and the next codebooks ``b{n+1}``: means rounded down, unused entries as they were."""
    return f"""
a{n} AS (SELECT id, part, any_value(x) AS x, min({{'d': list_sum(list_transform(list_zip(x, b), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT, 'entry': entry}}) AS best FROM p JOIN b{n} USING (part) GROUP BY id, part),
s{n} AS (SELECT part, entry, i, sum(v)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT part, best.entry AS entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY ALL),
m{n} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS b FROM s{n} GROUP BY ALL),
b{n + 1} AS (SELECT o.part, o.entry, coalesce(m.b, o.b) AS b FROM b{n} o LEFT JOIN m{n} m ON m.part = o.part AND m.entry = o.entry),"""


SQL["op13_vector_codes"] = rf"""
WITH e AS (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT id, part, list_slice(v, part * (len(v) // 16) + 1, (part + 1) * (len(v) // 16)) AS x FROM e, range(16) r(part)),
first AS (SELECT id, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM e WHERE vec_id IS NOT NULL),
b0 AS (SELECT part, entry, x AS b FROM p JOIN first USING (id) WHERE entry < 64),
{_round_sql(0)}{_round_sql(1)}
f AS (SELECT id, part, min({{'d': list_sum(list_transform(list_zip(x, b), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT, 'entry': entry}}) AS best FROM p JOIN b2 USING (part) GROUP BY id, part),
c AS (SELECT id, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM f GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, i)) FROM (SELECT part, entry, unnest(b) AS v, generate_subscripts(b, 1) AS i FROM b2)) AS codebooks_sha256
FROM e JOIN c USING (id)
"""
