"""Toxicity: Kneser-Ney models of toxic and of ordinary words, letter by letter, that back off to the same counts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import calibrated, held_out
from .storage import materialise

#: Labels of each class that the models are fitted on, at most; every third one calibrates, the others are counted.
SAMPLE = 20_000
#: Letters of an n-gram, taken off each count that is seen, and how many counts the shared distribution adds to each context of a class.
ORDER, DISCOUNT, PRIOR = 8, 0.9, 3.0
#: Log-likelihood ratios up to this much for a word come about by chance and count as none.
CHANCE = 3.0
#: Places of the table that is broadcast: 32 MB, whatever it was fitted on. N-grams that meet in a place share their mean.
PLACES = 1 << 23
#: Evidence a letter below which the score's scale is linear and above which it is logarithmic.
LINEAR = 0.002
#: Documents whose score is at least this are toxic.
THRESHOLD = 0.5
#: Words of at most so many letters that a worker remembers the evidence of, and how many of them.
REMEMBERED, LETTERS = 300_000, 40

_WORD = re.compile(r"[^\W\d_]+")
#: Marks before and after a word; they are no letters.
_START, _END = "\x02", "\x03"


@dataclass(frozen=True)
class Model:
    """``table`` has the log-likelihood ratio of each n-gram seen, and of each context with a letter not seen after it, by hash; NaN where there is none."""

    table: np.ndarray
    slope: float
    intercept: float


def words_of(text: str | None) -> list[str]:
    """The runs of letters, in lower case."""
    return _WORD.findall((text or "").lower())


class Evidence(dict):
    """By word: its log-likelihood ratio of toxic against ordinary, without what chance explains."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    def _at(self, gram: str) -> float:
        return float(self.table[zlib.crc32(gram.encode()) % PLACES])

    def __missing__(self, word: str) -> float:
        padded, ratio = _START * (ORDER - 1) + word + _END, 0.0
        for i in range(len(word) + 1):
            v = self._at(padded[i : i + ORDER])
            if v != v:  # not seen: the context's own weight, or nothing where that is new too
                v = self._at(padded[i : i + ORDER - 1])
            if v == v:
                ratio += v
        over = ratio - CHANCE if ratio > CHANCE else ratio + CHANCE if ratio < -CHANCE else 0.0
        if len(word) <= LETTERS and len(self) < REMEMBERED:
            self[word] = over
        return over


def _statistic(docs: DataFrame, table: np.ndarray):
    """A column function: text to evidence a letter, on a scale that is linear near 0. The table is broadcast compressed; most of its places are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(zstandard.compress(table.tobytes(), 1))

    @F.arrow_udf("double")
    def evidence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Evidence(np.frombuffer(zstandard.decompress(shared.value), np.float32))
        for texts in batches:
            if len(known) >= REMEMBERED:
                known.clear()
            out = []
            for text in texts:
                words = words_of(text.as_py())
                out.append(sum(map(known.__getitem__, words)) / max(1, sum(map(len, words)) + len(words)))
            yield pa.array(np.arcsinh(np.array(out, float) / LINEAR), pa.float64())

    return evidence


def _word_counts(texts: DataFrame) -> DataFrame:
    """(word, toxic, ordinary): how often each word stands in the different texts of (label, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list[int]] = {}
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in words_of(text):
                    found.setdefault(w, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), pa.array([n[1] for n in found.values()], pa.int64()), pa.array([n[0] for n in found.values()], pa.int64())], ["word", "toxic", "ordinary"]
            )

    found = texts.mapInArrow(counted, "word string, toxic long, ordinary long")
    return found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def ratios(words: DataFrame) -> DataFrame:
    """(gram, ratio, weight) of (word, toxic, ordinary): Kneser-Ney log-likelihood ratios of n-grams and, for letters not seen after them, of contexts.

    A class's n-gram of ``ORDER`` letters is discounted and backs off to the
    shorter ones, whose continuation counts are those of both classes
    together. So what neither class has seen, or too rarely, speaks for none.
    """
    padded = F.concat(F.lit(_START * (ORDER - 1)), F.col("word"), F.lit(_END))
    each = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(ORDER))))
    grams = materialise(words.select(each.alias("gram"), "toxic", "ordinary").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "grams")

    def ending(n: Column) -> Column:
        return F.substring("gram", ORDER - n + 1, n)

    # each different n-gram of 2 letters and more, and how many there are before each of one letter less
    kinds = grams.select(F.explode(F.transform(F.sequence(F.lit(2), F.lit(ORDER)), ending)).alias("kind")).distinct()
    shorter = kinds.groupBy(F.expr("substring(kind, 2)").alias("short")).agg(F.count(F.lit(1)).alias("n"))
    same = Window.partitionBy(F.length("short"), F.expr("left(short, length(short) - 1)"))
    total, different = F.sum("n").over(same), F.count(F.lit(1)).over(same)
    # what an n-gram has of its own, and what it takes of the next shorter one's
    shares = materialise(shorter.select("short", F.length("short").alias("letters"), ((F.col("n") - DISCOUNT) / total).alias("own"), (DISCOUNT * different / total).alias("rest"), different.alias("different")), "shares")
    backed = shares.where(F.col("letters") == 1).select(F.col("short").alias("known"), (F.col("own") + F.col("rest") / (F.col("different") + 1)).alias("p"))
    for n in range(2, ORDER):
        longer = shares.where(F.col("letters") == n).join(backed, F.expr("substring(short, 2)") == F.col("known"))
        backed = longer.select(F.col("short").alias("known"), (F.col("own") + F.col("rest") * F.col("p")).alias("p"))

    context = F.substring("gram", 1, ORDER - 1)
    rows = Window.partitionBy(context)
    classes = {}
    for c in ("toxic", "ordinary"):
        size, seen = F.sum(c).over(rows), F.sum((F.col(c) > 0).cast("long")).over(rows)
        rest = F.when(size > 0, (DISCOUNT * seen + PRIOR) / (size + PRIOR)).otherwise(1.0)
        classes |= {f"{c}_rest": rest, f"{c}_own": F.when(size > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / (size + PRIOR)).otherwise(0.0)}
    known = grams.join(backed, F.expr("substring(gram, 2)") == F.col("known")).withColumns(classes | {"context": context, "weight": (F.col("toxic") + F.col("ordinary")).cast("double")})
    likely = {c: F.col(f"{c}_own") + F.col(f"{c}_rest") * F.col("p") for c in ("toxic", "ordinary")}
    seen = known.select("gram", F.log(likely["toxic"] / likely["ordinary"]).alias("ratio"), "weight")
    unseen = known.groupBy(F.col("context").alias("gram")).agg(F.max(F.log(F.col("toxic_rest") / F.col("ordinary_rest"))).alias("ratio"), F.sum("weight").alias("weight"))
    return seen.unionByName(unseen)


def _table(words: DataFrame) -> np.ndarray:
    place = F.crc32(F.col("gram").cast("binary")) % PLACES
    found = ratios(words).groupBy(place.alias("place")).agg((F.sum(F.col("ratio") * F.col("weight")) / F.sum("weight")).cast("float").alias("ratio")).toArrow()
    table = np.full(PLACES, np.nan, np.float32)
    table[found["place"].to_numpy()] = found["ratio"].to_numpy()
    return table


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Models of ``labels`` (key, label: 1 toxic, 0 not) outside the held-out fold.

    The ``sample`` labels of each class that come first by their key's
    digest are learnt from: two of three are counted, each different text
    once a class, the third calibrates, with the classes weighed as they are
    in all the labels. Texts are whole. Of rows that repeat a labelled key
    all teach; a key with both labels teaches both. Null and empty texts
    teach nothing. If a class has no text, scores are a constant.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("k"), F.col(label).cast("int").alias("label")).distinct()
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    nothing = Model(np.full(PLACES, np.nan, np.float32), 0.0, float(np.log(share / (1 - share))))
    listed = []
    for c in (0, 1):
        first = usable.where(F.col("label") == c).orderBy(F.md5(F.col("k").cast("string").cast("binary")), "k").limit(sample).collect()
        listed += [(r["k"], c, n % 3 == 2) for n, r in enumerate(first)]
    chosen = docs.sparkSession.createDataFrame(listed, f"k {labels.schema[key].dataType.simpleString()}, label int, calibrates boolean")
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).where(F.col("text") != "")
    texts = materialise(own.join(F.broadcast(chosen), "k").select("label", "calibrates", "text").distinct(), "labelled")
    table = _table(_word_counts(texts.where(~F.col("calibrates")).select("label", "text")))
    rest = texts.where("calibrates")
    found = rest.select("label", _statistic(docs, table)(F.col("text")).alias("x")).toPandas()
    x, y = found["x"].to_numpy(float), found["label"].to_numpy(float)
    n = [int((y == c).sum()) for c in (0, 1)]
    if min(n) == 0:
        return nothing
    return Model(table, *calibrated(x, y, np.where(y == 1, share / n[1], (1 - share) / n[0]) * sum(n)))


def score_documents(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, 0 to 1, and predicted (1 if score >= threshold, else 0), from the text alone.

    The score grows with the mean over all letters of what the words' log-
    likelihoods say for toxic. Null and empty texts, and those without
    letters, get the score of no evidence. Equal texts score alike, repeated
    rows too; texts and words of any length are scored whole. An empty table
    stays empty; columns of those names are replaced, all others kept.
    Nothing is shuffled.
    """
    x = _statistic(docs, model.table)(F.col(text))
    return docs.withColumn("score", 1 / (1 + F.exp(-(model.slope * x + model.intercept)))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
