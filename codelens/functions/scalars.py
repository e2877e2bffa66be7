"""Text, list, score and path functions as columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """The table's value for a key, null for other keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def any_of(names: Sequence[str]) -> str:
    return "|".join(names)


def squeezed(text: Column) -> Column:
    """White space trimmed, and each run inside as one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def distinct_in_order(values: Column) -> Column:
    return F.array_distinct(values)


def listed(values: Column, limit: int = 5) -> Column:
    """The first values, how many more there are, or none."""
    some = F.array_join(F.slice(F.transform(values, lambda x: x.cast("string")), 1, limit), ", ")
    return F.when(F.coalesce(F.size(values), F.lit(0)) < 1, "none").when(F.size(values) > limit, F.concat(some, F.lit(", +"), (F.size(values) - limit).cast("string"), F.lit(" more"))).otherwise(some)


def truncated(text: Column, most: int, mark: str = "...[truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_")


def rule_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def column_of(raw: Column, needle: Column) -> Column:
    """Place of the needle from 1; null where it isn't."""
    at = F.locate(needle, raw) if isinstance(needle, str) else F.instr(raw, needle)
    return F.when(at > 0, at)


def rate(part: Column, whole: Column, places: int = 6) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, F.round(part.cast("double") / whole.cast("double"), places)).otherwise(F.lit(0.0))


def percent(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100.0)


def ceil_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0).otherwise(F.floor((a + b - 1) / b)).cast("long")


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def evidence_label(score: Column) -> Column:
    score = clamped(score)
    return F.when(score >= 0.80, "high").when(score >= 0.55, "medium").otherwise("low")


def verdict(score: Column) -> Column:
    score = clamped(score)
    return F.when(score >= 0.85, "true_positive").when(score >= 0.65, "likely").when(score >= 0.45, "unclear").otherwise("false_positive")


def severity_rank(severity: Column) -> Column:
    """0 for info to 4 for critical; unknown ones rank as medium."""
    at = F.array_position(words_of(vocab.SEVERITIES), severity)
    return F.when(at > 0, at - 1).otherwise(2).cast("int")


def severity_named(rank: Column) -> Column:
    return F.element_at(words_of(vocab.SEVERITIES), rank + 1)


def gated(impact: Column, evidence: Column) -> Column:
    """The impact, no higher than the evidence carries: any, high or medium."""
    ceiling = F.when(evidence == "high", 4).when(evidence == "medium", 3).otherwise(2)
    return severity_named(F.least(severity_rank(impact), ceiling))


def project_parts(path: Column) -> Column:
    """Lowercase parts of a path below the last harness folder and the two parts after it, if there are as many."""
    parts = F.filter(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), lambda x: ~x.isin("", "."))
    out = parts
    for marker in reversed(vocab.HARNESS_FOLDERS):
        at = F.size(parts) - F.array_position(F.reverse(parts), F.lit(marker)) + 1
        inside = F.array_contains(parts, marker) & (at + 1 < F.size(parts))
        out = F.when(inside, F.slice(parts, (at + 2).cast("int"), F.size(parts))).otherwise(out)
    return out


def deployment_contexts(path: Column) -> Column:
    """Which of test or example, vendored and generated code a path looks like."""
    parts = project_parts(path)
    stem = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"(?<=.)\.[^.]*$", "")
    joined = F.array_join(parts, "/")
    low = F.arrays_overlap(parts, words_of(vocab.LOW_RELEVANCE)) | stem.isin(vocab.LOW_RELEVANCE)
    generated = joined.rlike(any_of([g.replace(".", r"\.") for g in vocab.GENERATED]))
    found = F.array(
        F.when(low, "test_or_example_path"),
        F.when(F.arrays_overlap(parts, words_of(vocab.VENDORED)), "vendored_or_external_path"),
        F.when(generated, "generated_code"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def is_error_label(label: Column) -> Column:
    return F.lower(label).rlike(any_of(vocab.ERROR_LABELS))


def escaped(text: Column) -> Column:
    """Text as a pattern that matches just it."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
