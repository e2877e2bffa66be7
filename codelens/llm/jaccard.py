"""Exact self join on the Jaccard similarity of word shingles, by set relations.

Sets are ordered lists of 64-bit shingle hashes. The steps:

1. Equal sets become one: answers of one are answers of all its copies.
2. Each set meets the most central set of its minhash buckets. Those found
   similar form clusters; a member takes over its cluster's answers, so no
   pair inside a cluster is looked at again.
3. Prefixes (common shingles last) go into an inverted index. Its lists hold
   sizes and positions, by which pairs that can't reach the threshold are
   skipped; and a list is a list of clusters, whose blocks of members are
   skipped when sizes or positions rule out all of them.
4. What is left is answered first for the clusters' central sets. A member's
   answers are derived from its central set's: the overlap of two members is
   that of their central sets, but for what the members lack or add, which
   step 2 has counted. Where these bounds don't decide, whole sets do.
5. Links are joined into components.

Steps 1 and 2 only save work: step 3 loses no pair that isn't in one
component already. ``link_counts`` looks at the pairs inside clusters, too.
Two different shingles share a hash with a chance of 2**-64, which shifts an
overlap by one; two different sets of one size share both 64-bit sums with a
chance of 2**-128.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shingles import mix, shingle_sets, tidy
from .storage import materialise

#: Minhashes of a set, those by which it looks for the centre of a cluster, and those it must have in common with one to be compared.
HASHES, LOOKED_UP, AGREED = 8, 2, 4
#: Shingles that are counted together; those that FREQUENT sets of such a stretch have are common.
STRETCH, FREQUENT = 2_000_000, 2
#: Common shingles told apart by their counts, at most (8 MB); the order of the others is that of their hashes. Only the work depends on it.
ORDERED = 1 << 19
#: Cells of a set's outline: how many of its shingles fall in each. A set too large for one byte a cell has none.
CELLS = 256
#: A shingle's list with more clusters than this is cut into bands of size, of which only neighbours meet.
HOT = 64
#: Bits of the filter that keeps sets nobody asks for out of the shuffle (4 MB); when it is full, more sets are shuffled.
FILTER_BITS = 1 << 25

Batches = Iterator[pa.RecordBatch]


def _digest(s: np.ndarray) -> bytes:
    """What tells a set from others."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _flush(held: list[np.ndarray]) -> pa.RecordBatch:
    tokens, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
    keep = counts >= FREQUENT
    return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], ["token", "n"])


def _signatures(width: int) -> Callable[[Batches], Batches]:
    """Of each row: key, size, two sums that identify the set, minhashes."""
    seeds = [mix(np.array([k + 11], np.uint64))[0] for k in range(HASHES)]

    def run(batches: Batches) -> Batches:
        for b in batches:
            out = np.zeros((3 + HASHES, b.num_rows), np.uint64)
            outlines: list[bytes | None] = [None] * b.num_rows
            for row, s in shingle_sets(b.column(1), width):
                if len(s):
                    out[0, row], out[1, row], out[2, row] = len(s), s.sum(), mix(s ^ seeds[0]).sum()
                    for k, seed in enumerate(seeds):
                        out[3 + k, row] = mix(s + seed).min()
                    cells = np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                    if cells.max() < 256:
                        outlines[row] = cells.astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x.view(np.int64)) for x in out], pa.array(outlines, pa.binary())], ["id", "n", "k1", "k2", *[f"m{k}" for k in range(HASHES)], "outline"])

    return run


def _common(width: int) -> Callable[[Batches], Batches]:
    """(token, n): shingles that many different sets of one stretch have."""

    def run(batches: Batches) -> Batches:
        held: list[np.ndarray] = []
        size, seen = 0, set()
        for b in batches:
            for _, s in shingle_sets(b.column(0), width):
                if len(s) and (k := _digest(s)) not in seen:
                    seen.add(k)
                    held.append(s)
                    size += len(s)
                    if size >= STRETCH:
                        yield _flush(held)
                        held, size, seen = [], 0, set()
        yield _flush(held)

    return run


def _needed(n: int, percent: int) -> int:
    """The least overlap that a set of size n needs with any similar set."""
    return -(-percent * n // 100)


def _postings(width: int, percent: int, order: Broadcast) -> Callable[[Batches], Batches]:
    """(token, id, n, pos) of each set's prefix, common shingles last."""

    def run(batches: Batches) -> Batches:
        tokens, ranks = order.value
        for b in batches:
            ids, parts, size = b.column(0).to_numpy(zero_copy_only=False), [], 0
            seen = set()
            for row, s in shingle_sets(b.column(1), width):
                if not len(s) or (k := _digest(s)) in seen:
                    continue
                seen.add(k)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    s = s[np.argsort(np.where(tokens[at] == s, ranks[at], 0), kind="stable")]
                p = len(s) - _needed(len(s), percent) + 1
                parts.append((s[:p], np.full(p, ids[row]), np.full(p, len(s)), np.arange(p)))
                size += p
                if size >= 100_000:
                    yield _posted(parts)
                    parts, size = [], 0
            yield _posted(parts)

    return run


def _posted(parts: list[tuple]) -> pa.RecordBatch:
    t, i, n, p = (np.concatenate([x[k] for x in parts]) if parts else np.empty(0, np.int64) for k in range(4))
    return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(i.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(p.astype(np.int32))], ["token", "id", "n", "pos"])


def _shared_only(batches: Batches) -> Batches:
    """Of a partition sorted by token, the rows of tokens that have several rows. Holds one batch and one row."""
    held: pa.RecordBatch | None = None
    last, several = None, False
    for b in batches:
        if not b.num_rows:
            continue
        t = b.column(0).to_numpy(zero_copy_only=False)
        same = t[1:] == t[:-1]
        keep = np.zeros(len(t), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if held is not None:
            if last == t[0]:
                keep[0] = True
                if not several:
                    yield held
            # else: the row held back had no other of its token, or has been given already
        several = bool(keep[-1])
        last, held = t[-1], b.slice(b.num_rows - 1)
        yield b.filter(pa.array(keep))


def _asked_sets(width: int, wanted: Broadcast) -> Callable[[Batches], Batches]:
    """(id, shingles) of rows that pass the filter, a superset of those asked for."""

    def run(batches: Batches) -> Batches:
        bits = wanted.value
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            ok = np.ones(len(at), bool)
            for part in (at & np.uint64(FILTER_BITS - 1), (at >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)):
                ok &= (bits[(part >> np.uint64(3)).astype(np.int64)] >> (part & np.uint64(7)).astype(np.uint8)) & 1 == 1
            b = b.filter(pa.array(ok))
            ids, rows, sets, size = b.column(0), [], [], 0
            for row, s in shingle_sets(b.column(1), width):
                rows.append(row)
                sets.append(s.view(np.int64))
                size += len(s)
                if size >= 500_000:
                    yield _sets(ids, rows, sets)
                    rows, sets, size = [], [], 0
            yield _sets(ids, rows, sets)

    return run


def _sets(ids: pa.Array, rows: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])


def _views(column: pa.Array, kind: type) -> list[np.ndarray | None]:
    """Each value of a binary column as an array on the column's own memory."""
    wide = np.int32 if pa.types.is_binary(column.type) else np.int64
    ends = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].tolist()
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    there = column.is_valid().to_pylist()
    return [data[x:y].view(kind) if ok else None for x, y, ok in zip(ends[:-1], ends[1:], there, strict=True)]


def _overlaps(batches: Batches) -> Batches:
    for b in batches:
        x, y = (_views(b.column(k), np.uint64) for k in (2, 3))
        n = np.zeros((3, b.num_rows), np.int64)
        for row, (s, t) in enumerate(zip(x, y, strict=True)):
            both = np.concatenate((s, t))
            both.sort(kind="stable")  # two sorted runs
            n[:, row] = len(s), len(t), np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([*b.columns[:2], *map(pa.array, n)], ["a", "b", "na", "nb", "common"])


def _not_ruled_out(percent: int) -> Callable[[Batches], Batches]:
    """Pairs whose outlines leave room for similarity: the overlap is at most the sum of the smaller counts of each cell."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            na, nb = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 3))
            most = np.minimum(na, nb)
            for row, (x, y) in enumerate(zip(_views(b.column(4), np.uint8), _views(b.column(5), np.uint8), strict=True)):
                if x is not None and y is not None:
                    most[row] = np.minimum(x, y).sum(dtype=np.int64)
            keep = 100 * most >= percent * (na + nb - most)
            yield pa.RecordBatch.from_arrays(b.columns[:4], ["a", "na", "b", "nb"]).filter(pa.array(keep))

    return run


def _filter_bits(ids: DataFrame) -> np.ndarray:
    """A bit set of at most FILTER_BITS, made from aggregated words of 32 bits: its size doesn't depend on the data."""
    h = F.xxhash64("id")
    places = F.explode(F.array(h.bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(FILTER_BITS - 1))))
    parts = ids.select(places.alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("v"))
    found = parts.toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[found["w"].to_numpy()] = found["v"].to_numpy().astype(np.uint32)
    return bits.view(np.uint8)


def _possible(pairs: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, na, b, nb) whose outlines don't rule out that they are similar."""
    seen = pairs.join(outlines.toDF("a", "oa"), "a").join(outlines.toDF("b", "ob"), "b").select("a", "na", "b", "nb", "oa", "ob")
    return materialise(seen.mapInArrow(tidy(_not_ruled_out(percent)), "a long, na long, b long, nb long").distinct(), "open")


def _counted(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(a, b, na, nb, common) of the pairs (a, b): sizes and overlap of their whole sets."""
    spark = docs.sparkSession
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = spark.sparkContext.broadcast(_filter_bits(ids))
    sets = docs.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(tidy(_asked_sets(width, wanted)), "id long, shingles binary")
    sets = materialise(sets, "sets")
    both = pairs.select("a", "b").join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return materialise(both.mapInArrow(tidy(_overlaps), "a long, b long, na long, nb long, common long"), "counted")


def _similar(percent: int, common: str = "common") -> Column:
    return F.expr(f"100 * {common} >= {percent} * (na + nb - {common})")


def _anchors(stars: DataFrame, member: DataFrame) -> DataFrame:
    """(id, anchor, n_anchor, shared): for the members of stars (a, b, na, nb, common), the central set most like each, and their overlap.

    Central sets are their own anchors, and so have no row; nor have keys with several texts.
    """
    best = stars.groupBy(F.col("b").alias("id")).agg(F.max_by(F.struct("a", "na", "common"), F.struct(F.expr("common / (na + nb - common)"), F.negative("a"))).alias("c"))
    best = best.select("id", F.col("c.a").alias("anchor"), F.col("c.na").alias("n_anchor"), F.col("c.common").alias("shared"))
    best = best.join(stars.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
    repeated = materialise(member.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id"), "repeated")
    if not repeated.isEmpty():
        best = best.join(repeated, "id", "left_anti").join(repeated.toDF("anchor"), "anchor", "left_anti").select("id", "anchor", "n_anchor", "shared")
    return materialise(best, "anchors")


def _answers(docs: DataFrame, pairs: DataFrame, outlines: DataFrame, anchors: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, na, b, nb) whose sets are similar.

    With a's anchor c and b's anchor d, whose overlap is counted once for all
    their members, |a & b| is at least |c & d| - |c - a| - |d - b| and at most
    |c & d| + |a - c| + |b - d|. What these bounds leave open is counted.
    """
    near = _possible(pairs, outlines, percent)
    near = near.join(anchors.toDF("a", "c", "nc", "ac"), "a", "left").join(anchors.toDF("b", "d", "nd", "bd"), "b", "left")
    near = near.select("a", "na", "b", "nb", *[F.coalesce(x, y).alias(x) for x, y in (("c", "a"), ("nc", "na"), ("ac", "na"), ("d", "b"), ("nd", "nb"), ("bd", "nb"))])
    near = materialise(near.withColumns({"x": F.least("c", "d"), "y": F.greatest("c", "d")}), "anchored")
    centres = _counted(docs, near.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), width)
    known = centres.groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.min("common").alias("low"), F.max("common").alias("high"))
    rated = near.join(known, ["x", "y"], "left").withColumns({
        "least": F.when(F.expr("x = y"), F.expr("ac + bd - nc")).otherwise(F.expr("low - (nc - ac) - (nd - bd)")),
        "most": F.when(F.expr("x = y"), F.expr("least(ac, bd) + least(na - ac, nb - bd)")).otherwise(F.expr("least(na, nb, high + (na - ac) + (nb - bd))")),
    })
    rated = materialise(rated.where(_similar(percent, "most")).withColumn("sure", _similar(percent, "least")).select("a", "b", "sure"), "rated")
    sure, unsure = rated.where("sure").select("a", "b"), rated.where("NOT sure").select("a", "b")
    if unsure.isEmpty():
        return sure.distinct()
    return sure.union(_counted(docs, unsure.distinct(), width).where(_similar(percent)).select("a", "b")).distinct()


def _reachable(n: str, m: str, p: str, q: str, percent: int) -> Column:
    """Whether two sets can be similar: by their sizes, and by what follows the positions of a shingle that both have."""
    least = F.ceil(F.expr(f"cast({percent} * ({n} + {m}) as double) / {100 + percent}") - 1e-9)
    return F.expr(f"100 * {m} >= {percent} * {n}") & F.expr(f"100 * {n} >= {percent} * {m}") & (F.least(F.expr(f"{n} - {p}"), F.expr(f"{m} - {q}")) >= least)


def _linked(docs: DataFrame, width: int, percent: int, key: str, text: str, inside: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, the class of each set (id, class, n), and links (a, b) of classes: all if ``inside``, else enough to join each component."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    minhashes = [f"m{k}" for k in range(HASHES)]
    signed = materialise(docs.select("id", "text").mapInArrow(tidy(_signatures(width)), "id long, n long, k1 long, k2 long, " + ", ".join(f"{m} long" for m in minhashes) + ", outline binary"), "signatures")
    keyed = docs.where("id IS NOT NULL")
    real = signed.where("n > 0 AND id IS NOT NULL")

    # 1. equal sets are one class, named by the smallest key
    classes = materialise(real.groupBy("n", "k1", "k2").agg(F.min("id").alias("id"), *[F.first(m).alias(m) for m in minhashes], F.first("outline").alias("outline")), "classes")
    outlines = classes.select("id", "outline")
    member = materialise(real.select("id", "n", "k1", "k2").distinct().join(classes.select("n", "k1", "k2", F.col("id").alias("class")), ["n", "k1", "k2"]).select("id", "class", "n"), "members")

    # the order of shingles: common ones last
    common = docs.select("text").mapInArrow(tidy(_common(width)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = common.orderBy(F.desc("n"), "token").limit(ORDERED).toArrow()
    tokens, counts = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    by_token = np.argsort(tokens)
    order = spark.sparkContext.broadcast((tokens[by_token], counts[by_token]))

    # 3a. prefixes, and of them the shingles that several classes have
    posted = keyed.mapInArrow(tidy(_postings(width, percent, order)), "token long, id long, n int, pos int")
    shared = posted.repartition("token").sortWithinPartitions("token").mapInArrow(_shared_only, "token long, id long, n int, pos int")
    shared = shared.join(member.select("id", "class"), "id").groupBy("token", "class", "n").agg(F.min("pos").alias("pos"))
    shared = materialise(shared, "index")

    # 2. clusters around the most central set of each minhash bucket: the one with the most shared shingles for its size
    central = shared.groupBy("class").agg((F.count(F.lit(1)) / F.max("n")).alias("central"))
    seen = classes.join(central.withColumnRenamed("class", "id"), "id", "left").select("id", "n", F.coalesce("central", F.lit(0.0)).alias("central"), F.array(*minhashes).alias("m"))
    looked = seen.select("*", F.posexplode(F.slice("m", 1, LOOKED_UP)).alias("k", "key"))
    bucket = looked.groupBy("k", "key").agg(F.max(F.struct("central", F.negative("id").alias("minus"), "n", "m")).alias("top"), F.count(F.lit(1)).alias("size")).where("size > 1")
    agreed = F.aggregate(F.zip_with("m", "top.m", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    stars = looked.join(bucket, ["k", "key"]).where(agreed >= AGREED).select(F.negative("top.minus").alias("a"), F.col("top.n").alias("na"), F.col("id").alias("b"), F.col("n").alias("nb"))
    stars = stars.where(F.expr(f"a <> b AND 100 * na >= {percent} * nb AND 100 * nb >= {percent} * na")).distinct()
    stars = materialise(stars, "stars")
    stars = _counted(keyed, _possible(stars, outlines, percent), width).where(_similar(percent))
    linked = stars.select("a", "b").distinct()
    anchors = _anchors(stars, member)
    cluster = connected_components(linked, "a", "b")

    # 3b. lists of clusters; only pairs over two clusters are left
    index = shared.join(cluster.select(F.col("node").alias("class"), F.col("component").alias("cluster")), "class", "left").withColumn("cluster", F.coalesce("cluster", "class"))
    index = materialise(index, "clustered")
    lists = index.groupBy("token", "cluster").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.expr("n - pos")).alias("room"))
    several = lists.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    lists = lists.join(several, "token")
    # sizes of similar sets lie in one band of a long list or in two that touch
    width_of = max(math.log(100 / percent), 1e-3) * 1.000001
    low, high = (F.floor(F.ln(c) / F.lit(width_of)).cast("int") for c in ("low", "high"))
    hot = F.col("k") > HOT
    x = lists.withColumn("band", F.explode(F.when(hot, F.sequence(low, high)).otherwise(F.array(F.lit(0))))).select("token", "band", "cluster", "low", "high", "room").toDF("token", "band", "cx", "lx", "hx", "rx")
    y = lists.withColumn("band", F.explode(F.when(hot, F.sequence(low - 1, high + 1)).otherwise(F.array(F.lit(0))))).select("token", "band", "cluster", "low", "high", "room").toDF("token", "band", "cy", "ly", "hy", "ry")
    meet = F.expr(f"cx < cy AND 100 * hx >= {percent} * ly AND 100 * hy >= {percent} * lx AND {100 + percent} * rx >= {percent} * (lx + ly) AND {100 + percent} * ry >= {percent} * (lx + ly)")
    blocks = x.join(y, ["token", "band"]).where(meet).select("token", "cx", "cy", "ly", "hy", "ry")
    left = blocks.join(index.select("token", F.col("cluster").alias("cx"), F.col("class").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa")), ["token", "cx"])
    left = left.where(f"100 * na >= {percent} * ly AND 100 * hy >= {percent} * na AND {100 + percent} * (na - pa) >= {percent} * (na + ly) AND {100 + percent} * ry >= {percent} * (na + ly)").drop("ly", "hy", "ry")
    pairs = left.join(index.select("token", F.col("cluster").alias("cy"), F.col("class").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb")), ["token", "cy"])
    pairs = materialise(pairs.where(_reachable("na", "nb", "pa", "pb", percent)).select("a", F.col("na").cast("long").alias("na"), "b", F.col("nb").cast("long").alias("nb")).distinct(), "candidates")

    # 4. answers, from those of central sets
    more = linked.union(_answers(keyed, pairs, outlines, anchors, width, percent))
    if not inside:
        return signed, member, more

    # 5. the pairs inside clusters that the stars left out
    own = index.join(cluster.select("component").distinct().toDF("cluster"), "cluster", "left_semi")
    x, y = (own.select("token", "cluster", F.col("class").alias(c), F.col("n").cast("long").alias(f"n{c}"), F.col("pos").alias(f"p{c}")) for c in "ab")
    pairs = x.join(y, ["token", "cluster"]).where(F.col("a") < F.col("b")).where(_reachable("na", "nb", "pa", "pb", percent)).select("a", "na", "b", "nb").distinct()
    pairs = materialise(pairs.join(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti").select("a", "na", "b", "nb"), "inside")
    return signed, member, more.union(_answers(keyed, pairs, outlines, anchors, width, percent))


def similar_sets(docs: DataFrame, width: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, links, component_id) for each row of ``docs``.

    Two rows link when 100 * |intersection| >= percent * |union| of their
    distinct ``width``-word shingles. ``component_id`` is the smallest key
    that links reach. ``links`` is true where the row links with any other.
    Null and empty texts, and those of white space only, have no shingles
    and no links; one with fewer words than ``width`` is one shingle. Rows
    that repeat a key are rows of their own in the result; a key with several
    texts links with whatever any of them links with, and so ties their
    groups. Keys are whole numbers; rows with a null key are returned with
    component null and link with nothing. Very long texts are one set like
    any other. An empty table gives an empty result. Other columns are left
    out, whatever their names.
    """
    signed, member, found = _linked(docs, width, percent, key, text, inside=False)
    grouped = connected_components(found, "a", "b")
    # a class's component starts from its smallest key
    home = member.join(grouped.select(F.col("node").alias("class"), "component"), "class", "left").select("id", F.coalesce("component", "class").alias("component_id"))
    home = home.groupBy("id").agg(F.min("component_id").alias("component_id"))
    sizes = member.join(grouped.select(F.col("node").alias("class"), F.lit(True).alias("other")), "class", "left")
    copies = member.groupBy("class").agg(F.count(F.lit(1)).alias("copies"))
    links = sizes.join(copies, "class").groupBy("id").agg(F.max(F.coalesce("other", F.lit(False)) | (F.col("copies") > 1)).alias("links"))
    result = signed.select("id", F.col("n").alias("n_shingles")).join(home, "id", "left").join(links, "id", "left")
    return result.select(F.col("id").alias(key), "n_shingles", F.coalesce("links", F.lit(False)).alias("links"), F.coalesce("component_id", "id").alias("component_id"))


def link_counts(docs: DataFrame, width: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, n_links) for each row of ``docs``: with how many other rows it links, as ``similar_sets`` says.

    Equal sets are looked at once and count as often as they stand in
    ``docs``. All pairs of different sets are verified, those inside a
    cluster too; so the work grows with the number of links. Keys should not
    repeat with different texts.
    """
    signed, member, found = _linked(docs, width, percent, key, text, inside=True)
    rows = signed.where("n > 0 AND id IS NOT NULL").join(member.select("id", "n", "class"), ["id", "n"])
    copies = rows.groupBy("class").agg(F.count(F.lit(1)).alias("copies"))
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = pairs.union(pairs.select("b", "a")).toDF("class", "other").join(copies.toDF("other", "n_other"), "other")
    others = ends.groupBy("class").agg(F.sum("n_other").alias("others"))
    per_class = copies.join(others, "class", "left").select("class", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    per_key = member.join(per_class, "class").groupBy("id").agg(F.max("n_links").alias("n_links"))
    return signed.select("id", F.col("n").alias("n_shingles")).join(per_key, "id", "left").select(F.col("id").alias(key), "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))
