"""Places and the stretches of lines that hold them, by an equal join on bins of lines: no place meets a stretch of another bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a bin. A stretch has a row for each bin that it reaches into, a place one.
WIDTH = 64


def _bin(line: Column) -> Column:
    return F.floor(line / WIDTH)


def binned(spans: DataFrame, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """``spans`` once for each bin that they reach into, as ``bin``; those that end before they begin in none."""
    return spans.where(F.col(start) <= F.col(end)).withColumn("bin", F.explode(F.sequence(_bin(F.col(start)), _bin(F.col(end)))))


def held(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str = "start_line", end: str = "end_line", also: list[str] = ()) -> DataFrame:
    """Each different place (keys, at, and what is ``also`` told of it) with each of the ``spans`` (keys, start, end and more) that hold it."""
    places = points.select(*keys, at, *also).distinct().withColumn("bin", _bin(F.col(at)))
    return places.join(binned(spans, start, end), [*keys, "bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("bin")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal keys whose stretches of lines ``a`` and ``b`` overlap, once each: in the first bin that both reach into."""
    both = binned(left, *a).join(binned(right, *b), [*keys, "bin"])
    return both.where((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])) & (F.col("bin") == F.greatest(_bin(F.col(a[0])), _bin(F.col(b[0]))))).drop("bin")


def merged(spans: DataFrame, keys: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """(keys, start, end): the spans' lines as stretches that don't overlap, so that a place is in one at most."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) > before).cast("int"), F.lit(1))
    rows = spans.select(*keys, start, end).where(F.col(start) <= F.col(end)).withColumn("new", new).withColumn("group", F.sum("new").over(order))
    return rows.groupBy(*keys, "group").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("group")


def inside(points: DataFrame, spans: DataFrame, keys: list[str], at: str, out: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """``points`` with ``out``: whether any span holds the place. Rows stay as they are; a file with many of them is spread by bins."""
    names = {k: f"__{n}" for n, k in enumerate([*keys, start, end, "bin"])}
    own = binned(merged(spans, keys, start, end), start, end).select(*[F.col(k).alias(v) for k, v in names.items()])
    rows = points.withColumn("__at", _bin(F.col(at)))
    same = (F.col("__at") == F.col(names["bin"])) & F.col(at).between(F.col(names[start]), F.col(names[end]))
    for k in keys:
        same &= F.col(k) == F.col(names[k])
    return rows.join(own, same, "left").withColumn(out, F.col(names["bin"]).isNotNull()).drop("__at", *names.values())
