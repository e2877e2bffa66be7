"""Vector codes: each part of a vector as the number of the nearest entry of that part's codebook, in whole numbers throughout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise, unused

#: Components are multiplied by this and rounded down.
SCALE = 256
#: Scaled components are smaller than this, so that no distance, nor a sum over a vector of a million components, leaves 64 bits.
LARGEST = 1 << 21
#: Vectors whose distances are computed together.
TOGETHER = 4096


def scaled(vector: str) -> Column:
    """The integer components of the array column ``vector``: null where it is null or has a null or non-finite one."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return F.when(finite, F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)))


def _matrix(rows: pa.Array, width: int) -> np.ndarray:
    """The batch as int64, one row a vector."""
    lengths = rows.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise ValueError(f"vectors have {width} components; one has {lengths[lengths != width][0]}")
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), width)
    if x.size and max(-x.min(), x.max()) >= LARGEST:
        raise ValueError(f"components must lie within {LARGEST // SCALE} of 0")
    return x


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the first of the nearest rows of ``book``, and the squared distance: |x|2 - 2 x.b + |b|2, exact in int64."""
    distance = (book * book).sum(1)[None, :] - 2 * (x @ book.T)
    best = distance.argmin(1)
    return best, distance[np.arange(len(x)), best] + (x * x).sum(1)


def _parts(x: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its components, nearest entries, squared distances) for each of the consecutive parts."""
    step = books.shape[2]
    for part, book in enumerate(books):
        own = np.ascontiguousarray(x[:, part * step : (part + 1) * step])
        yield part, own, *nearest(own, book)


def _refined(vectors: DataFrame, shared: Broadcast, width: int) -> np.ndarray:
    """The codebooks after one round: each entry that has vectors becomes their components' mean, rounded down."""
    books = shared.value
    parts, entries, step = books.shape
    sums = ", ".join(f"s{i} long" for i in range(step))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, step), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                for part, own, best, _ in _parts(_matrix(b.column(0).slice(at, TOGETHER), width), shared.value):
                    np.add.at(total[part], best, own)
                    count[part] += np.bincount(best, minlength=entries)
        part, entry = np.nonzero(count)
        rows = [part, entry, count[part, entry], *(total[part, entry, i] for i in range(step))]
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)) for r in rows], ["part", "entry", "n", *(f"s{i}" for i in range(step))])

    found = vectors.select("x").mapInArrow(summed, f"part long, entry long, n long{', ' if sums else ''}{sums}")
    merged = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(step)])
    books = books.copy()
    for r in merged.collect():  # at most one row for each entry of each part
        books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(step)]
    return books


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error) of each row, and the codebooks, integers of shape (parts, entries, components of a part).

    The components, times ``SCALE`` and rounded down, are cut into ``parts``
    equal consecutive parts. Codebooks begin as the parts of the vectors with
    the ``entries`` smallest keys (of a repeated key all rows, the smaller
    vector first) and are refined ``rounds`` times by all vectors. ``code``
    is an array with the entry of each part, ``error`` the sum of the parts'
    squared distances.

    Rows whose vector is null, or holds a null or non-finite component, are
    left out; those with a null key or label are coded, but start no
    codebook if the key is null. With fewer than ``entries`` keys the
    codebooks are so much shorter; with none there is no row. All vectors
    must have as many components, a multiple of ``parts``, within 8,192 of
    0; others are an error. Repeated rows are coded each, other columns left
    out. The table is read ``rounds`` + 2 times; what goes through the driver
    is the codebooks and a row for each of their entries.
    """
    rows = vectors.select(F.col(key).alias("k"), F.col(label).alias("label"), scaled(vector).alias("x")).where(F.col("x").isNotNull())
    first = [r["x"] for r in rows.where(F.col("k").isNotNull()).orderBy("k", "x").select("x").limit(entries).collect()]
    width = len(first[0]) if first else 0
    if width % parts or any(len(x) != width for x in first):
        raise ValueError(f"vectors must have as many components, a multiple of {parts}")
    books = np.array(first, np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    if books.size and max(-books.min(), books.max()) >= LARGEST:
        raise ValueError(f"components must lie within {LARGEST // SCALE} of 0")
    sc = vectors.sparkSession.sparkContext
    kinds = ", ".join(f"`{c}` {vectors.schema[n].dataType.simpleString()}" for c, n in ((key, key), (label, label)))
    if not first:
        return vectors.sparkSession.createDataFrame([], f"{kinds}, code array<int>, error long"), books
    for _ in range(rounds):
        books = _refined(rows, sc.broadcast(books), width)
    shared = sc.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                found = [(best, distance) for _, _, best, distance in _parts(_matrix(part.column(2), width), shared.value)]
                code = np.stack([best for best, _ in found], 1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, code.shape[1], dtype=np.int32)), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, pa.array(sum(distance for _, distance in found))], [key, label, "code", "error"])

    return rows.mapInArrow(coded, f"{kinds}, code array<int>, error long"), books


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with label_error, the sum of error over the rows of equal labels, nulls together.

    ``coded`` is written first, so that both uses read one result. The sums
    are joined as Spark sees fit by their size: a label that holds much of
    the rows is summed before the shuffle, and split if it must be shuffled.
    """
    rows = materialise(coded, "codes")
    other = unused(rows, "summed_label")
    sums = rows.groupBy(F.col(label).alias(other)).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, F.col(label).eqNullSafe(F.col(other))).drop(other)
