"""Running totals inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import unused


def running_total(df: DataFrame, group: list[str], digest: str, value: str, out: str, ties: list[Column] = ()) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come earlier by (``digest``, ``ties``).

    ``digest`` is a column of lowercase hex digits, spread evenly. Its first
    three digits split each group into 4,096 parts, which are summed first;
    so no task sorts a whole group. Rows alike in digest and ties are
    interchangeable.
    """
    own, other, inner, before = (unused(df, c) for c in ("part", "other_part", "inner_total", "earlier_total"))
    keys = [unused(df, f"group_{i}") for i in range(len(group))]
    part = F.substring(F.col(digest), 1, 3)
    sums = df.groupBy(*[F.col(g).alias(k) for k, g in zip(keys, group, strict=True)], part.alias(other)).agg(F.sum(value).alias("sum"))
    earlier = Window.partitionBy(*keys).orderBy(other).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, other, F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(*group, own).orderBy(digest, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn(own, part).withColumn(inner, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col(own).eqNullSafe(F.col(other))
    for k, g in zip(keys, group, strict=True):
        same &= F.col(g).eqNullSafe(F.col(k))
    return rows.join(sums, same).withColumn(out, F.col(before) + F.col(inner)).drop(own, other, inner, before, *keys)
