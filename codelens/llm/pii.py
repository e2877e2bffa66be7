"""Personal data: patterns, and terms that reveal protected entities by what the corpus says of them.

DataFrame functions only. Positions are code points from 0, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise, unused

#: Kinds of base spans in the order of ties, and their patterns. Possessive loops, the card's least length and the
#: anchors at a run's start (or the last match's end) change no valid match; they keep long runs linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
#: What a span becomes: entities are generalised to their kind, revealing terms are removed.
REPLACEMENTS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[REDACTED]"}
#: A term reveals an entity if their pointwise mutual information is at least this part of the entity's information.
DISCLOSURE = 0.9
#: Terms that are broadcast to be counted (some 20 MB), at most; more are joined.
BROADCAST = 200_000
#: Different lines in which a term and an entity must stand together before their statistics count.
SUPPORT = 3
TERM = r"[\p{L}\p{N}_]+"
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _valid(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern passes its checks."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda x: F.regexp_replace(x, "^0+", "").rlike("^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        # from the right, every second digit counts double, less 9 where that is above 9
        values = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 1, F.translate(x, "0123456789", "0246813579")).otherwise(x).cast("int"))
        return F.length(digits).between(12, 19) & (F.aggregate(values, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0)
    return F.lit(True)


def _located(text: Column, pattern: Column, kind: int) -> Column:
    """(start, kind, end, match) of each match: the lengths of what lies between matches and of the matches add up to places."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>").alias("found"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["match"]), F.lit(0))
        here = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["match"].alias("match")))
        return F.struct(end.alias("at"), F.when(part["match"].isNull(), state["found"]).otherwise(F.concat(state["found"], here)).alias("found"))

    return F.aggregate(parts, begin, step, lambda s: s["found"])


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["match"])


def _entities(line: Column, kind: str) -> Column:
    """The valid matches of one kind, as (kind, entity)."""
    found = F.filter(F.regexp_extract_all(line, F.lit(PATTERNS[kind]), F.lit(0)), lambda x: _valid(kind, x))
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), F.lower(x).alias("entity")))


def base_spans(text: Column) -> Column:
    """The base spans of a text, by start and kind; none for null."""
    found = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        here = F.filter(_located(text, F.lit(pattern), n), _passes(kind))
        found.append(F.when(text.rlike(pattern), _bare(here)).otherwise(F.array().cast(SPAN)))
    return F.coalesce(F.array_sort(F.concat(*found)), F.array().cast(SPAN))


def _lines(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.explode(F.split(F.col(text), "\n")).alias("line"))


def _terms(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0)))


def _sized(terms: DataFrame, of: DataFrame) -> DataFrame:
    """``terms`` broadcast if ``of``, a written table that they come from, has BROADCAST rows at most."""
    return F.broadcast(terms) if of.count() <= BROADCAST else terms


def revealing_terms(docs: DataFrame, text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(term, kind, entity, together, entity_lines, term_lines, ratio): terms that reveal entities of the corpus.

    A line with an entity is a context of it. Equal lines are one in every
    count, so copies of a document neither prove nor hide anything. With N
    different lines in all, e contexts of the entity, t lines with the term
    and b contexts with both, the information of the entity is log2(N/e), that of the pair
    log2(b*N/(e*t)), and ``ratio`` the second over the first: 1 for a term
    that stands where the entity does and nowhere else. Terms that reach
    ``disclosure`` over at least ``support`` contexts are returned. A term
    whose lines in a 64th of all, by digest, are already too many for that
    is not counted further.
    """
    lines = _lines(docs, text)
    held = lines.where(F.greatest(*[F.col("line").rlike(p) for p in PATTERNS.values()]))
    entities = F.concat(*[_entities(F.col("line"), k) for k in PATTERNS])
    masked = F.col("line")
    for p in PATTERNS.values():
        masked = F.regexp_replace(masked, p, " ")
    contexts = held.select(F.unhex(F.md5(F.col("line").cast("binary"))).alias("context"), masked.alias("rest"), F.explode(F.array_distinct(entities)).alias("e")).select("context", "rest", "e.*")
    contexts = materialise(contexts.groupBy("kind", "entity", "context").agg(F.first("rest").alias("rest")), "contexts")
    strong = contexts.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("entity_lines")).where(F.col("entity_lines") >= support)
    pairs = contexts.join(strong, ["kind", "entity"]).select("kind", "entity", "entity_lines", F.explode(_terms(F.col("rest"))).alias("term"))
    pairs = pairs.groupBy("kind", "entity", "entity_lines", "term").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= support)
    pairs = materialise(pairs, "pairs")
    # lines are told apart by a digest of 128 bits: their texts aren't shuffled
    digest = F.unhex(F.md5(F.col("line").cast("binary"))).alias("digest")
    n = lines.select(digest).distinct().count()
    # a term may stand in b*(N/e)**(1-disclosure) lines at most; one that stands in more of a 64th of them, by digest, needs no count
    most = F.max(F.col("together") * F.pow(F.lit(float(n)) / F.col("entity_lines"), 1.0 - disclosure) + 1)
    wanted = pairs.groupBy("term").agg(most.alias("most"))
    few = lines.select("line", digest).where(F.conv(F.hex(F.substring("digest", 1, 1)), 16, 10).cast("int") % 64 == 0)
    seen = few.select("digest", F.explode(_terms(F.col("line"))).alias("term")).join(_sized(wanted.select("term"), pairs), "term", "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("least"))
    wanted = materialise(wanted.join(seen, "term", "left").where(F.coalesce("least", F.lit(0)) <= F.col("most")).select("term"), "wanted")
    here = lines.select(digest, F.explode(_terms(F.col("line"))).alias("term")).join(_sized(wanted, wanted), "term", "left_semi").distinct()
    counts = here.groupBy("term").agg(F.count(F.lit(1)).alias("term_lines"))
    rated = pairs.join(counts, "term").withColumn("n", F.lit(n)).withColumn("ratio", F.log2(F.col("together") * F.col("n") / (F.col("entity_lines") * F.col("term_lines"))) / F.log2(F.col("n") / F.col("entity_lines")))
    return rated.where(F.col("ratio") >= disclosure).select("term", "kind", "entity", "together", "entity_lines", "term_lines", "ratio")


def find_pii(docs: DataFrame, text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT, base: str = "pii_base", spans: str = "pii_spans") -> DataFrame:
    """``docs`` with pii_base and pii_spans (or as ``base`` and ``spans`` say): arrays of (start, kind, end) by start, kind an index into KINDS.

    pii_base has the pattern matches of each kind, which may overlap those
    of another. pii_spans has these and, as kind 'term', the occurrences of
    terms that reveal an entity anywhere in the corpus, in any document,
    where they don't touch a base span. Null and empty texts have none.
    Repeated rows are marked alike, and texts of any length are whole. An
    empty table stays empty. Columns of those names are replaced, all others
    are kept.
    """
    terms = materialise(revealing_terms(docs, text, disclosure, support).select("term").distinct(), "terms")
    none = F.array().cast(SPAN)
    if terms.isEmpty():
        return docs.withColumn(base, base_spans(F.col(text))).withColumn(spans, F.col(base))
    same, pattern, hits = (unused(docs, c) for c in ("text_id", "pattern", "term_spans"))
    # 256 bits stand for a text, so no two meet
    text_id = F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias(same)
    held = docs.select(text_id, F.explode(_terms(F.col(text))).alias("term")).join(terms, "term")
    word = r"\p{L}\p{N}_"
    patterns = held.groupBy(same).agg(F.array_sort(F.collect_set("term")).alias("own"))
    patterns = materialise(patterns.select(same, F.concat(F.lit(rf"(?iu)(?<![{word}])(?:"), F.array_join("own", "|"), F.lit(rf")(?![{word}])")).alias(pattern)), "patterns")
    marked = docs.withColumn(base, base_spans(F.col(text))).select("*", text_id).join(patterns, same, "left")
    found = F.when(F.col(pattern).isNotNull(), _bare(_located(F.col(text), F.col(pattern), KINDS.index("term")))).otherwise(none)
    marked = marked.withColumn(hits, found)
    free = F.filter(hits, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return marked.withColumn(spans, F.array_sort(F.concat(base, free))).drop(same, pattern, hits)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced as REPLACEMENTS says; overlapping spans become one.

    Null and empty texts stay as they are, and so do texts without spans.
    Other columns are kept.
    """
    base, spans = unused(docs, "base"), unused(docs, "spans")
    names = F.array(*[F.lit(REPLACEMENTS[k]) for k in KINDS])
    marked = find_pii(docs, text, disclosure, support, base, spans)
    whole = F.col(text)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        ahead = x["start"] >= state["at"]
        piece = F.array(F.substr(whole, state["at"] + 1, x["start"] - state["at"]), F.element_at(names, x["kind"] + 1))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(ahead, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out"))

    clean = F.aggregate(spans, begin, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(whole, s["at"] + 1, F.length(whole))))
    return marked.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(whole)).drop(base, spans)
