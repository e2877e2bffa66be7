"""Source trees, and a corpus of C text generated from an events table.

The corpus gives queries something to parse whose facts can also be computed
from the rows that made it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab

#: What an event writes: (condition, lines parted by |). The first that holds counts; both engines read the same text.
EVENT_LINES = [
    ("event_type = 'signup' AND event_id % 5 = 0", "f = fopen(d, m);"),
    ("event_type = 'signup' AND event_id % 5 = 1", "pthread_mutex_lock(mu);"),
    ("event_type = 'signup' AND event_id % 5 = 2", "q = malloc(n);|if (!q)|    return NULL;"),
    ("event_type = 'signup'", "p = (char *) malloc(16);"),
    ("event_type = 'purchase' AND event_id % 5 = 0", "fclose(f);"),
    ("event_type = 'purchase' AND event_id % 5 = 1", "pthread_mutex_unlock(mu);"),
    ("event_type = 'purchase' AND event_id % 5 = 2", "buffer_release(q);"),
    ("event_type = 'purchase'", "free(p);"),
    ("event_type = 'view' AND event_id % 4 = 0", "if (n < len)|    n++;"),
    ("event_type = 'view' AND event_id % 4 = 1", "if (rc != 0)|    n++;"),
    ("event_type = 'view' AND event_id % 4 = 2", "if (hdr_type == 7)|    n++;"),
    ("event_type = 'view'", "if (!p)|    n++;"),
    ("event_type = 'error' AND event_id % 4 = 0", "if (x)|    goto out;"),
    ("event_type = 'error' AND event_id % 4 = 1", "return NULL;"),
    ("event_type = 'error' AND event_id % 4 = 2", "free(p);|goto fail;"),
    ("event_type = 'error'", "if (x)|    return -1;"),
    ("event_id % 7 = 0", "strcpy(d, s);"),
    ("event_id % 7 = 1", "if (0)|    n++;"),
    ("event_id % 7 = 2", "n = atoi(s);"),
    ("event_id % 7 = 3", "helper(x); // return NULL;"),
    ("event_id % 7 = 4", "p = NULL;"),
    ("event_id % 7 = 5", "work(x); /* goto no; */"),
    ("TRUE", "fn_1(\"free(p); { \", x);"),
]
#: What stands after the events, by user_id % 3.
CLOSINGS = ["out:|free(p);|free(p);|return -1;|fail:|goto out;", "out:|free(p);|return 0;", "return 0;"]
#: Where a user's file lies, by user_id % 10; other users' files are in src.
FOLDERS = {0: "tests", 1: "third_party/lib", 2: "src/generated"}


def _cases(pairs: list[tuple[str, str]], other: str | None = None) -> str:
    quoted = [(c, t.replace("'", "''")) for c, t in pairs]
    return "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in quoted) + (f" ELSE '{other}'" if other else "") + " END"


LINES_SQL = _cases(EVENT_LINES)
CLOSING_SQL = _cases([(f"user_id % 3 = {k}", t) for k, t in enumerate(CLOSINGS)])
PATH_SQL = _cases([(f"user_id % 10 = {k}", t) for k, t in FOLDERS.items()], "src")


def generated_corpus(events: DataFrame, keep: str = "TRUE") -> DataFrame:
    """(path, content): a file with one function for each user, a line or more for each of the user's events that ``keep`` lets through."""
    rows = events.where(keep).select("user_id", F.struct("ts", "event_id", F.expr(LINES_SQL).alias("t")).alias("r"))
    users = rows.groupBy("user_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    body = F.transform("rs", lambda r: F.concat(F.lit("    "), F.replace(r["t"], F.lit("|"), F.lit("\n    "))))
    text = F.concat(
        F.lit("#include <stdlib.h>\n\nint fn_"), F.col("user_id").cast("string"), F.lit("(char *p, int x) {\n"), F.array_join(body, "\n"),
        F.lit("\n"), F.replace(F.expr(CLOSING_SQL), F.lit("|"), F.lit("\n")), F.lit("\n}\n"),
    )
    return users.select(F.expr(f"concat({PATH_SQL}, '/fn_', user_id, '.c')").alias("path"), text.alias("content"))


#: The first line of a function's brace in the generated files.
BRACE_LINE = 3

#: For DuckDB: (path, fn, line, stmt) of each code line of the generated corpus, comments and strings taken out, made from the rows alone.
LINES_CTE = rf"""
written AS (SELECT user_id, ts, event_id, string_split({LINES_SQL}, '|') AS parts FROM events WHERE KEPT),
closed AS (SELECT user_id, ts, event_id, parts, 0 AS tail FROM written
  UNION ALL SELECT user_id, NULL, NULL, string_split({CLOSING_SQL}, '|'), 1 FROM (SELECT DISTINCT user_id FROM written)),
placed AS (SELECT *, coalesce(sum(len(parts)) OVER (PARTITION BY user_id ORDER BY tail, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM closed),
each_line AS (SELECT user_id, before, parts, unnest(range(1, len(parts) + 1)) AS k FROM placed),
code_lines AS (
  SELECT {PATH_SQL} || '/fn_' || user_id || '.c' AS path, 'fn_' || user_id AS fn, ({BRACE_LINE} + before + k)::INTEGER AS line,
         trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(parts[k], '//.*$', ''), '/\*.*?\*/', ' ', 'g'), '"[^"]*"', '""', 'g'), '\s+', ' ', 'g')) AS stmt,
         parts[k] AS raw
  FROM each_line)
"""


def lines_cte(keep: str = "TRUE", name: str = "") -> str:
    """The CTEs up to code_lines; ``name`` is put behind each table's name."""
    text = LINES_CTE.replace("WHERE KEPT)", f"WHERE {keep})")
    for t in ("written", "closed", "placed", "each_line", "code_lines"):
        text = text.replace(f"{t} AS", f"{t}{name} AS").replace(f"FROM {t}", f"FROM {t}{name}")
    return text


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the C and C++ files below a folder.

    Folders of version control and caches are left out before any content is
    read. Files that aren't valid UTF-8 are skipped; CRLF and CR become LF.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    parts = F.split("path", "/")
    skipped = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in vocab.SKIPPED_FOLDERS]))
    files = files.where(suffix.isin(vocab.SOURCE_SUFFIXES) & ~skipped)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("path", F.regexp_replace(text, "\r\n?", "\n").alias("content")).where("content IS NOT NULL")


def language(path: str = "path") -> Column:
    """c, cpp or unknown, by the suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(suffix.isin("c", "h"), "c").when(suffix.isin("cc", "cpp", "hpp"), "cpp").otherwise("unknown")


def build_files(spark: SparkSession, root: str) -> DataFrame:
    """(name, path): build files below a folder, and of each name the first path by order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").isin(vocab.BUILD_FILES))
    return named.groupBy("name").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("files"))
