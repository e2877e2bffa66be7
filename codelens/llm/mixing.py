"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running_total
from .storage import unused

#: The words of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: How far a source's weight rises (or falls, below 0) over the run, against its mean: w(t) = w * (1 + slope * (2t - 1)).
SLOPES = (0.5, -0.5)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """(source, source_size, target, goal, slope) from (source, size) rows.

    Sources in order of code point, null last, weigh ``weights`` in turn;
    that is the integral of each one's schedule over the run. They share all
    sizes by weight; a target stops at ``cap`` times its source's size and
    the excess goes to the others by weight until none is above. In order of
    size for its weight, the sources that stop come first; so one pass finds
    the level at which the rest share. ``goal`` is the target's whole words.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(order) - 1
    listed = by_source.withColumn("__n", number)
    listed = listed.withColumns({
        "__w": F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("__n") % len(weights) + 1),
        "slope": F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), F.col("__n") % len(slopes) + 1),
    })
    by_room = everything.orderBy((F.col("source_size") / F.col("__w")), "__n")
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    listed = listed.withColumns({
        "__left": F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)),
        "__share": F.sum("__w").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    listed = listed.withColumn("__level", F.when(F.col("__left") * F.col("__w") <= cap * F.col("source_size") * F.col("__share"), F.col("__left").cast("double") / F.col("__share").cast("double")))
    # sources before the first that can take its level stop at their cap; that level holds for the others
    stops = F.sum(F.col("__level").isNotNull().cast("int")).over(by_room.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 0
    first = F.first("__level", ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    listed = listed.withColumn("target", F.when(stops, (cap * F.col("source_size")).cast("double")).otherwise(F.least(first * F.col("__w"), (cap * F.col("source_size")).cast("double"))))
    return listed.select("source", "source_size", "target", F.floor("target").cast("long").alias("goal"), "slope")


def _place(asked: Column) -> Column:
    """Where the source's schedule (``slope``) has asked for the share ``asked`` of its words."""
    s = F.col("slope")
    return ((s - 1.0) + F.sqrt((1.0 - s) * (1.0 - s) + 4.0 * s * asked)) / (2.0 * s)


def measured(docs: DataFrame, text: str = "text", out: str = "size") -> DataFrame:
    """``docs`` with ``out``, the number of words of the text; 0 for null."""
    return docs.withColumn(out, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long")))


def allocate(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, slopes: tuple[float, ...] = SLOPES, key: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None) -> DataFrame:
    """``docs`` with size, done, source_size, target, goal, slope, taken and position.

    ``taken`` words of each document go into the mix. All of a source's
    documents are taken as often as its goal holds its size; in order of
    their key's digest they are taken once more until the goal is reached,
    the last of them in part. So each source gives its target, less than a
    word short, and no document more than ``cap`` times its size.
    ``position`` from 0 to 1 is where the document first stands in training:
    the place at which its source's integrated schedule has asked for the
    words up to the document's middle. Null where nothing is taken. ``done``
    words of the source come before the document in each pass over it.

    Null texts have size 0 and are never taken; a null source is a source.
    Rows with the same key, null ones too, follow each other by size; equal
    rows are interchangeable, so reruns agree. Texts of any length are
    counted whole, and an empty table stays empty. Columns of the same names
    are replaced, all others are kept. ``size`` names a column that has the
    texts' sizes already (see ``measured``); no text is needed then.
    """
    sized = measured(docs, text) if size is None else docs.withColumn("size", F.col(size))
    digest, other = unused(docs, "digest"), unused(docs, "of_source")
    sized = sized.withColumn(digest, F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")))
    targets = source_targets(sized.select(F.col(source).alias("source"), "size"), weights, cap, slopes).withColumnRenamed("source", other)
    sized = sized.drop(*[c for c in ("source_size", "target", "taken", "position", "goal", "slope", "done") if c not in (key, text, source)])
    placed = running_total(sized, [source], digest, "size", "done", ties=[F.col("size")])
    placed = placed.join(targets, F.col(source).eqNullSafe(F.col(other)))
    whole = F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0))
    rest = F.col("goal") - whole * F.col("source_size")
    placed = placed.withColumn("taken", whole * F.col("size") + F.greatest(F.lit(0), F.least(rest - F.col("done"), F.col("size"))))
    asked = (F.col("done").cast("double") + F.least("size", "taken").cast("double") / 2.0) / F.col("goal").cast("double")
    placed = placed.withColumn("position", F.when(F.col("taken") > 0, _place(asked)))
    return placed.drop(digest, other)


def in_order(allocated: DataFrame, key: str = "doc_id") -> DataFrame:
    """``allocated`` range-sorted by position; what isn't taken comes last, by a hash of the key, so no range holds all of that."""
    order = [F.col("position").asc_nulls_last(), F.xxhash64(key).asc(), F.col(key).asc()]
    return allocated.repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(allocated: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row for each time that a document is read, range-sorted by position, with copy (from 0) and copy_words.

    ``allocated`` is a result of ``allocate``. A document that isn't taken
    has no row. Each copy stands where the source's integrated schedule has
    asked for the passes before it and for the words up to its own middle;
    so the passes follow each other and all of the run has its share.
    """
    copies = F.expr("CASE WHEN taken > 0 THEN sequence(0L, (taken + size - 1) div size - 1) ELSE array() END")
    rows = allocated.withColumn("copy", F.explode(copies))
    rows = rows.withColumn("copy_words", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")))
    before = (F.col("copy") * F.col("source_size") + F.col("done")).cast("double")
    rows = rows.withColumn("position", _place((before + F.col("copy_words").cast("double") / 2.0) / F.col("goal").cast("double"))).drop("done", "goal", "slope")
    return (rows.repartitionByRange(partitions, "position") if partitions else rows.repartitionByRange("position")).sortWithinPartitions("position")
