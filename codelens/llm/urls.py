"""URL filter: host and path rules, carried over redirects and canonical links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialise, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for ``host`` with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rule set that op10 is asked to apply.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one or for null."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """What makes two URLs one node: host, path and query. Scheme and fragment don't count. Null without a host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)))


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; of two as long, the one that allows. Null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


#: Character references that URLs have, and what they stand for; & comes last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))
#: What holds no links of the page, its canonical links and its refresh redirects, and their targets.
NO_LINKS = r"(?is)<!--.*?(-->|$)|<(script|style|template|noscript)\b.*?</(script|style|template|noscript)\s*>"
CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
TARGET = r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"


def _without_dots(path: Column) -> Column:
    """The path with its . and .. segments worked off."""
    step = lambda done, x: F.when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x))
    parts = F.split(path, "/")
    whole = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.lit(""), step)
    return F.concat(whole, F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))


def _resolved(links: DataFrame) -> DataFrame:
    """(src, dst) of links (src, target): the target made absolute, without . and .. in its path; steps are columns, as each is used several times."""
    target = F.col("target")
    for reference, plain in REFERENCES:
        target = F.replace(target, F.lit(reference), F.lit(plain))
    src = F.col("src")
    out = links.select("src", target.alias("target"), F.regexp_extract(src, r"^([^:/?#]*):", 1).alias("scheme"), host_of(src).alias("host"), path_of(src).alias("path"), F.regexp_extract(_rest(src), r"^[^/?#]*[^?#]*([^#]*)", 1).alias("query"))
    out = out.withColumns({"origin": F.concat("scheme", F.lit("://"), "host"), "folder": F.regexp_extract("path", r"^(.*/)?", 0)})
    target = F.col("target")
    whole = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat("scheme", F.lit(":"), target))
        .when(target.startswith("/"), F.concat("origin", target))
        .when(target.startswith("?"), F.concat("origin", "path", target))
        .when(target.startswith("#"), F.concat("origin", "path", "query"))
        .when(target != "", F.concat("origin", F.when(F.col("folder") != "", F.col("folder")).otherwise("/"), target))
    )
    out = materialise(out.select("src", whole.alias("dst")).where("dst IS NOT NULL"), "absolute")
    plain = out.where(~F.coalesce(path_of(F.col("dst")).contains("/."), F.lit(False)))
    dotted = out.where(path_of(F.col("dst")).contains("/.")).select("src", "dst", path_of(F.col("dst")).alias("path"))
    rest = F.regexp_extract(_rest(F.col("dst")), r"^[^?#]*([^#]*)", 1)
    return plain.union(dotted.select("src", F.concat(F.regexp_extract("dst", r"^[^:/?#]*", 0), F.lit("://"), host_of(F.col("dst")), _without_dots(F.col("path")), rest)))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) URLs: from each page to its canonical links and to the targets of its refresh redirects.

    Links in comments, scripts, styles, templates and noscript don't count.
    """
    clean = F.regexp_replace(html, NO_LINKS, " ")
    each = lambda element, part: F.transform(F.regexp_extract_all(F.col("clean"), F.lit(element), F.lit(0)), lambda x: F.regexp_extract(x, part, 1))
    targets = F.concat(each(CANONICAL, HREF), each(REFRESH, TARGET))
    found = pages.where(F.col(html).rlike(r"(?i)canonical|http-equiv")).select(F.col(url).alias("src"), clean.alias("clean")).select("src", F.explode(targets).alias("target"))
    found = materialise(found.where("target != '' AND src IS NOT NULL"), "links")
    return _resolved(found)


def judge_urls(pages: DataFrame, edges: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    The longest rule that fits a page's URL decides. A page that none fits
    takes the block of its component: URLs tied by ``edges`` (src, dst; the
    page's canonical links and redirects) are one, and one blocked URL among
    them, on a page or not, blocks the aliases. An explicit allow holds for
    the URL that it fits, whatever its aliases get. The rest is allowed.

    Null or empty URLs, and those without ``://``, have empty host and path,
    no rule and no aliases. URLs are compared as they are, not by hashes.
    Repeated rows are judged alike, long URLs are whole, and an empty table
    stays empty. Columns of the same names are replaced, all others kept.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    name, verdict = matched(host, path, rules)
    own, node, caught_by = (unused(pages, c) for c in ("own_verdict", "node", "caught"))
    judged = pages.withColumn(own, verdict)
    if edges is not None:
        ends = edges.select(address_of(F.col("src")).alias("src"), address_of(F.col("dst")).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
        ends = materialise(ends, "aliases")
        members = connected_components(ends, "src", "dst")
        its = F.col("node")
        blocked = matched(F.regexp_extract(its, r"^[^/?]*", 0), F.regexp_extract(its, r"^[^/?]*([^?]*)", 1), rules)[1] == "block"
        groups = members.where(F.coalesce(blocked, F.lit(False))).select("component").distinct()
        caught = members.join(groups, "component", "left_semi").select(F.col("node").alias(node), F.lit(True).alias(caught_by))
        # rows without an address meet nothing, so each gets a key of its own: no task has them all
        alone = F.concat(F.lit("/"), F.monotonically_increasing_id().cast("string"))
        judged = judged.withColumn(node, F.coalesce(address_of(F.col(url)), alone)).join(caught, node, "left").drop(node)
    else:
        judged = judged.withColumn(caught_by, F.lit(False))
    judged = judged.withColumns({"rule": name, "host": host, "path": path})
    passed = F.when(F.col(caught_by), "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce(own, passed)).drop(own, caught_by)
