"""Forward as-of: the first mark after each point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_after(points: DataFrame, marks: DataFrame, keys: list[str], on: str, out: str) -> DataFrame:
    """``points`` with ``out``: the least ``on`` of the marks with the same keys that is greater than the point's own.

    One sort by keys and place, from the end, so that each row adds to what
    the rows after it have left; no pair of a point and a mark is ever made.
    Null where no mark follows. Marks repeat freely; points keep their rows.
    """
    both = points.withColumn("__mark", F.lit(None).cast(points.schema[on].dataType))
    rows = marks.select(*keys, on).distinct().withColumn("__mark", F.col(on)).withColumn("__is_mark", F.lit(True))
    both = both.withColumn("__is_mark", F.lit(False)).unionByName(rows, allowMissingColumns=True)
    ahead = Window.partitionBy(*keys).orderBy(F.desc(on)).rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn(out, F.min("__mark").over(ahead)).where(~F.col("__is_mark")).drop("__mark", "__is_mark")


def last_of(marks: DataFrame, keys: list[str], on: str, out: str) -> DataFrame:
    """The greatest ``on`` of each key's marks."""
    return marks.groupBy(*keys).agg(F.max(on).alias(out))
