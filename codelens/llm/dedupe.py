"""One document of each group of near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import similar_sets
from .storage import materialise, unused


def without_copies(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less those that links (see ``similar_sets``) tie to a row with a smaller key.

    Of rows with the same key the one with the first text (null before all)
    stays. Documents without words, and rows with a null key, are tied to
    nothing and stay. An empty table stays empty. Columns are kept.
    """
    copy, twin, first = (unused(docs, c) for c in ("copy_key", "twin_key", "first_row"))
    groups = similar_sets(docs, width, percent, key, text)
    copies = materialise(groups.where(F.col("component_id") < F.col(key)).select(F.col(key).alias(copy)).distinct(), "copies")
    kept = docs.join(copies, F.col(key) == F.col(copy), "left_anti")
    again = materialise(docs.groupBy(F.col(key).alias(twin)).agg(F.count(F.lit(1)).alias(first)).where(F.col(twin).isNotNull() & (F.col(first) > 1)).select(twin), "repeated")
    if again.isEmpty():
        return kept
    twins = kept.join(again, F.col(key) == F.col(twin), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    twins = twins.groupBy(F.col(key).alias(twin)).agg(F.min_by(whole, F.struct(F.col(text), F.to_json(whole))).alias(first)).select(f"{first}.*")
    return kept.join(again, F.col(key) == F.col(twin), "left_anti").unionByName(twins)
