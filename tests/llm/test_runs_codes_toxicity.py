"""Periodic runs, vector codes and toxicity against plain versions, and on nulls, ties, repeats, odd texts and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelens.llm import codes, queries, repeats, toxicity
from codelens.llm.quality import held_out

SMALL = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "é 漢字 😀 " * 3), (6, "a" * 50_000), (7, "x y z " * 20_000), (None, "a a a a a a a")]


def _documents(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in more.items():
        docs = docs.withColumn(name, F.lit(value))
    return docs


# --- 12: runs


def _plain_runs(words, exponent=2, least=0):
    """By period, each stretch of words that equal those a period on; periods that a shorter one explains left out."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q) and not any(a <= i and a + k >= j + q for a, k, _ in out):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(500):
        n, letters = rnd.randint(0, 60), rnd.choice([1, 2, 2, 3, 4, 8])
        s = [rnd.randrange(letters) for _ in range(n)]
        if n > 4 and rnd.random() < 0.4:
            p, k = rnd.randint(1, n // 2), rnd.randrange(n - 1)
            s = [s[i] if i < k else s[k + (i - k) % min(p, n - k)] for i in range(n)]
        s = [sorted(set(s)).index(x) for x in s]
        assert repeats.all_runs(s) == _plain_runs(s)
        assert repeats.runs_of([b"%d" % x for x in s]) == _plain_runs(s, 4, 6)
        assert repeats.runs_of([b"%d" % x for x in s], 3, 5) == _plain_runs(s, 3, 5)


def test_vocabulary_holds_each_different_square():
    rnd = random.Random(9)
    for _ in range(300):
        s = [rnd.randrange(2) for _ in range(rnd.randint(1, 40))] + [2]
        tree, squares = repeats.vocabulary(s)
        want = {tuple(s[i : i + 2 * k]) for i in range(len(s)) for k in range(1, len(s) // 2 + 1) if s[i : i + k] == s[i + k : i + 2 * k] and i + 2 * k <= len(s)}
        got = [tuple(s[tree.low[v] : tree.low[v] + n]) for v, n in squares]
        assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("s", [[0] * 20_000, [i % 97 for i in range(20_000)], [bin(i).count("1") % 2 for i in range(20_000)]])
def test_long_repeats_take_linear_time(s):
    runs = repeats.all_runs(s)
    assert all(s[a : a + n - q] == s[a + q : a + n] for a, n, q in runs[:200])
    if s[:3] == [0, 0, 0]:
        assert runs == [(0, 20_000, 1)]
    if s[1:3] == [1, 2]:
        assert runs == [(0, 20_000, 97)]


def test_stretches_lose_no_run_among_other_words():
    rnd = random.Random(3)
    for _ in range(60):
        words = []
        while len(words) < 400:
            if rnd.random() < 0.2:
                piece = [rnd.randrange(30) for _ in range(rnd.randint(1, 12))]
                words += (piece * 9)[: rnd.randint(1, 8 * len(piece))]
            else:
                words += [rnd.randrange(30) for _ in range(rnd.randint(1, 30))]
        assert repeats.runs_of([b"%d" % x for x in words]) == _plain_runs(words, 4, 6)


def _row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = _plain_runs(w, 4, 6)
    kept = [True] * n
    for a, k, q in runs:
        kept[a + q : a + k] = [False] * (k - q)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, digest("".join(f"{a},{k},{q}\n" for a, k, q in runs)), digest(" ".join(x for x, keep in zip(w, kept, strict=True) if keep)))


def test_runs_query_equals_plain_version(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(k, " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 90)))) for k in range(400)]
    rows += [(1000 + k, t) for k, t in enumerate(["a\x1cb \xa0 " * 9, "a b c " * 8, "\x0b\x0c\x85 x" * 9, None, "", "w " * 6, "w " * 5, "é é é é é é"])] + [(None, "q " * 9), (3, "again " * 8), (3, "again " * 8)]
    _documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((_row(*r) for r in rows), key=repr)


def test_runs_on_odd_rows(spark):
    got = repeats.find_runs(_documents(spark, ODD, runs="old", found="kept", collapsed="old"))
    assert set(got.columns) == {"doc_id", "text", "runs", "found", "collapsed"} and got.count() == len(ODD)
    rows = {r.doc_id: r for r in got.collect()}
    assert [tuple(x) for x in rows[7].runs] == [(0, 60_000, 3)] and rows[7].collapsed == "x y z" and rows[7].found == "kept"
    assert [tuple(x) for x in rows[5].runs] == [] and rows[5].collapsed == " ".join("é 漢字 😀 ".split() * 3)
    assert rows[1].runs == [] and rows[1].collapsed == "" and rows[1].text is None and rows[None].collapsed == "a"
    assert repeats.find_runs(_documents(spark, [])).count() == 0


# --- 13: vector codes


def _plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(k, [math.floor(256 * float(np.float32(x))) for x in v], c) for k, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    seeds = [v for _, v in sorted((k, v) for k, v, _ in kept if k is not None)[:entries]]
    step = len(seeds[0]) // parts
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for v in seeds] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            new.append([[sum(c) // len(own[i]) for c in zip(*own[i], strict=True)] if i in own else e for i, e in enumerate(book)])
        books = new
    found = [(k, c, [near(cut(v, p), books[p]) for p in range(parts)]) for k, v, c in kept]
    sums = Counter()
    for _, c, n in found:
        sums[c] += sum(d for d, _ in n)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((k, "".join(f"{i:02x}" for _, i in n), sum(d for d, _ in n), sums[c], digest) for k, c, n in found), key=repr)


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("n", [5, 64, 300])
def test_codes_equal_brute_force(spark, tmp_path, n):
    rnd = random.Random(n)
    rows = [(rnd.randrange(10 * n), [rnd.gauss(0, 0.3) for _ in range(32)], rnd.choice([None, 0, 1, 2])) for _ in range(n)]
    rows += [(1, None, 0), (2, [None] + [0.0] * 31, 1), (3, [float("nan")] * 32, 1), (4, [float("inf")] + [0.0] * 31, None), (None, [0.5] * 32, 7), rows[0], rows[0]]
    _vectors(spark, rows).withColumn("code", F.lit("clash")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _plain_codes(rows)


def test_ties_go_to_the_first_entry():
    book = np.array([[0, 0], [2, 0], [2, 0]])
    best, distance = codes.nearest(np.array([[1, 0], [2, 0], [3, 1], [-(1 << 20), 1 << 20]]), book)
    assert best.tolist() == [0, 1, 1, 0] and distance.tolist() == [1, 0, 2, 2 << 40]


def test_codes_of_odd_tables(spark):
    coded, books = codes.encode(_vectors(spark, []))
    assert codes.with_label_errors(coded).count() == 0 and books.shape[:2] == (16, 0)
    assert codes.encode(_vectors(spark, [(None, [1.0] * 16, 1)]))[0].count() == 0
    coded, _ = codes.encode(_vectors(spark, [(1, [], 1), (1, [], None)]))
    assert [(r.code, r.error) for r in coded.collect()] == [([0] * 16, 0)] * 2
    for wrong in ([(1, [1.0] * 15, 1)], [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], [(1, [1e6] * 16, 1)]):
        with pytest.raises(Exception, match="component"):
            codes.encode(_vectors(spark, wrong))[0].collect()


# --- 11: toxicity


def _plain_ratios(words):
    """Kneser-Ney by the book, with dictionaries: the ratio of a whole word, n-gram by n-gram."""
    n, d = toxicity.ORDER, toxicity.DISCOUNT
    grams = lambda w: [("\x02" * (n - 1) + w + "\x03")[i : i + n] for i in range(len(w) + 1)]
    count = [Counter(), Counter()]
    for w, toxic, ordinary in words:
        for g in grams(w):
            count[1][g] += toxic
            count[0][g] += ordinary
    kinds = set(count[0]) | set(count[1])
    before = {}
    for k in range(n - 1, 0, -1):
        before[k] = Counter(g[1:] for g in kinds)
        kinds = set(before[k])

    def shared(g):
        if not g:
            return 1 / (len(before[1]) + 1)
        same = [c for x, c in before[len(g)].items() if x[:-1] == g[:-1]]
        if not same:
            return shared(g[1:])
        return (max(before[len(g)][g] - d, 0) + d * len(same) * shared(g[1:])) / sum(same)

    def ratio(g):
        p, out = shared(g[1:]), []
        for c in count:
            same = [v for x, v in c.items() if x[:-1] == g[:-1] and v]
            out.append((max(c[g] - d, 0) + (d * len(same) + toxicity.PRIOR) * p) / (sum(same) + toxicity.PRIOR) if same else p)
        return math.log(out[1] / out[0])

    return lambda word: sum(ratio(g) for g in grams(word))


def test_ratios_equal_plain_kneser_ney(spark):
    rnd = random.Random(2)
    words = [(w, rnd.randrange(4), rnd.randrange(1, 30)) for w in {"".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 12))) for _ in range(80)}]
    words += [("xyzzy" + e, 6, 0) for e in ("", "a", "bc")]
    table = toxicity._table(spark.createDataFrame(words, "word string, toxic long, ordinary long"))
    plain, chance = _plain_ratios(words), toxicity.CHANCE
    known = toxicity.Evidence(table)
    for w in [w for w, *_ in words] + ["xyzzyb", "xyz", "abcd", "zzz", "q"]:
        r = plain(w)
        assert known[w] == pytest.approx(r - chance if r > chance else r + chance if r < -chance else 0, abs=1e-3), w
    assert known["xyzzy"] > 1


def test_toxic_documents_on_held_out_rows(spark):
    got = queries.op11_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic, other = (got[got.toxic == c] for c in (1, 0))
    assert (toxic.predicted == 1).mean() > 0.9 and (other.predicted == 1).mean() < 0.02
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_toxicity_learns_from_no_held_out_label(spark):
    docs = _documents(spark, [(k, f"common words {'and bad zorblax' if k % 4 == 1 else 'here'} {k} " * 5) for k in range(120)])
    labels = spark.createDataFrame([(k, int(k % 4 == 1)) for k in range(120)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert np.array_equal(a.table, b.table, equal_nan=True) and (a.slope, a.intercept) == (b.slope, b.intercept)
    new = _documents(spark, [(1, "some zorblax here"), (2, "common words here")])
    scores = {r.doc_id: r.score for r in toxicity.score_documents(new, a).collect()}
    assert scores[1] > 0.5 > scores[2]


def test_toxicity_on_odd_rows(spark):
    docs = _documents(spark, ODD, k="clash", label="clash", score="old")
    for labels in ([], [(1, 1), (2, 0)], [(k, 1) for k in range(8)], [(4, 0), (4, 1), (7, 1), (5, 0), (None, 1), (5, 7)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.score_documents(docs, model)
        assert got.columns == [*docs.columns, "predicted"]
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.collect()) and got.count() == len(ODD)
    assert toxicity.score_documents(_documents(spark, []), model).count() == 0
