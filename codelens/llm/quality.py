"""Compression classifier: which of two zstandard dictionaries, of good and of bad text, shortens a text more."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

#: Labelled documents of each class that the model is fitted on, at most: half for its dictionary, half for calibration.
SAMPLE = 3000
#: Characters of whole texts that a class's dictionary is made of (no text begins beyond them), and its bytes, both at most.
FIT_CHARS, DICTIONARY = 16_000_000, 1_000_000
#: A text is compressed in pieces of so many bytes, so that it doesn't become its own dictionary.
PIECE, LEVEL = 200, 3
#: Documents whose score is at least this are kept.
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**options)
    own = zstandard.ZstdCompressionDict(dictionary)
    own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=own, **options)


def difference(text: str | None, good: bytes, bad: bytes) -> float:
    """By how much the good dictionary shortens the whole text more than the bad one, against the longer result: -1 to 1, 0 for empty."""
    data = (text or "").encode()
    if not data:
        return 0.0
    g, b = _compressor(good), _compressor(bad)
    pieces = [data[at : at + PIECE] for at in range(0, len(data), PIECE)]
    with_good, with_bad = sum(len(g.compress(p)) for p in pieces), sum(len(b.compress(p)) for p in pieces)
    return (with_bad - with_good) / max(with_bad, with_good)


def _dictionary(texts: list[str]) -> bytes:
    """A dictionary trained on the texts; where there are too few for that on their pieces, and where those won't do either all different pieces themselves."""
    samples = [t.encode() for t in texts if t]
    pieces = [s[at : at + PIECE] for s in samples for at in range(0, len(s), PIECE)]
    for these in (samples, pieces):
        try:
            return zstandard.train_dictionary(DICTIONARY, these, level=LEVEL).as_bytes()
        except (zstandard.ZstdError, ValueError):
            pass
    return b"".join(dict.fromkeys(pieces))


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve, by Newton's method with a small ridge; the slope isn't negative."""
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-3 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def held_out(key: Column) -> Column:
    """Whether a row's label is never learnt from: crc32 of the key as text is a multiple of 5. False for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of ``labels`` (key, label: 1 good, 0 bad) outside the held-out fold.

    The ``sample`` labels of each class that come first by their key's
    digest are learnt from: every second one by the class's dictionary, the
    others by the calibration, which weighs the classes as they are in all
    the labels. Texts are whole in both; those of the calibration stay in the
    executors. Of rows that repeat a labelled key the first text counts; a
    key with both labels is learnt from as both. Null and empty texts teach
    nothing. If a class has no text, scores are a constant.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).distinct()
    own = docs.select(F.col(key).alias("__key"), F.col(text).alias("t")).where(F.col("t") != "")  # no other column, whatever its name
    counts = {r["__label"]: r["n"] for r in usable.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for k in (0, 1):
        part = usable.where(F.col("__label") == k).withColumn("__order", F.md5(F.col("__key").cast("string").cast("binary"))).orderBy("__order", "__key").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    order = ["__order", "__key", "__label"]
    # read once; of a repeated key the text that comes first, so reruns agree
    found = own.join(F.broadcast(chosen), "__key").groupBy(*order).agg(F.min("t").alias("t"))
    found = materialise(found, "labelled")
    sized = found.select(*order, F.length("t").alias("t")).toPandas().sort_values(order)
    parts = {k: sized[sized["__label"] == k] for k in (0, 1)}
    share = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    if min(len(p) for p in parts.values()) < 2:
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))

    def held(rows: list[pd.DataFrame], column: Column) -> pd.DataFrame:
        """``column`` as t for these rows, in order."""
        listed = [r for part in rows for r in zip(*(part[c].tolist() for c in order), strict=True)]
        wanted = docs.sparkSession.createDataFrame(listed, chosen.select(*order).schema)
        return found.join(F.broadcast(wanted), order).select(*order, column.alias("t")).toPandas().sort_values(order)

    learnt = [p[::2] for p in parts.values()]
    texts = held([p[p["t"].cumsum() - p["t"] < FIT_CHARS] for p in learnt], F.col("t"))
    bad, good = (_dictionary(texts[texts["__label"] == k]["t"].tolist()) for k in (0, 1))
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))

    @F.arrow_udf("double")
    def differences(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([difference(t.as_py(), *shared.value) for t in column], pa.float64())

    rows = held([p[1::2] for p in parts.values()], differences(F.col("t")))
    x, y = rows["t"].to_numpy(float), rows["__label"].to_numpy(float)
    n = [int((y == k).sum()) for k in (0, 1)]
    weight = np.where(y == 1, share / n[1], (1 - share) / n[0]) * sum(n)
    return Model(good, bad, *calibrated(x, y, weight))


def scorer(docs: DataFrame, model: Model):
    """A column function: text to score, 0 to 1. The model (2 MB at most) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            x = np.array([difference(t.as_py(), m.good, m.bad) for t in texts], float)
            yield pa.array(1 / (1 + np.exp(-np.clip(m.slope * x + m.intercept, -30, 30))))

    return score


def score_documents(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted (1 if score >= threshold, else 0), from the text alone.

    Null and empty texts get the score of no difference. Equal texts score
    alike, repeated rows too, and texts of any length are scored whole. An
    empty table stays empty; columns of those names are replaced, all others
    kept. Nothing is shuffled.
    """
    return docs.withColumn("score", scorer(docs, model)(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
