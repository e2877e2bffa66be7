"""Runs: stretches of words that repeat with a period, by the linear tandem-repeat method of Gusfield and Stoye.

The squares (a block of words twice in a row) that begin leftmost are covered
by those found at the borders of Lempel-Ziv blocks. Their places in the
suffix tree are marked, and walks along suffix links complete the vocabulary
of all different squares. The leaves below a mark are a square's occurrences;
squares of one period at consecutive places merge into a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import unused

#: The words of a run, at least: this many, and this many times its period.
LENGTH, EXPONENT = 6, 4

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixTree:
    """The suffix tree of whole numbers from 0 whose last one stands nowhere else (Ukkonen's construction).

    By node, 0 being the root: ``parent``, ``depth`` (letters from the root),
    ``link`` (suffix link), ``low`` (the first place where its string stands);
    ``leaves[first[v] : first[v] + size[v]]`` are all places. ``edge`` has the
    child by node * ``letters`` + letter.
    """

    def __init__(self, s: list[int]) -> None:
        self.s, self.letters = s, max(s) + 1
        start, end = self._grown()
        self._measured(start, end)

    def _grown(self) -> tuple[list[int], list[int]]:
        s, letters, n = self.s, self.letters, len(self.s)
        start, end, link, edge = [0], [0], [0], {}
        node = length = waiting = at = 0
        for i, letter in enumerate(s):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    at = i
                key = node * letters + s[at]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(start)
                    start.append(i), end.append(n), link.append(0)
                    if unlinked:
                        link[unlinked], unlinked = node, 0
                else:
                    whole = min(end[child], i + 1) - start[child]
                    if length >= whole:
                        node, at, length = child, at + whole, length - whole
                        continue
                    middle = start[child] + length
                    if s[middle] == letter:
                        if unlinked:
                            link[unlinked] = node
                        length += 1
                        break
                    split = edge[key] = len(start)
                    start.append(start[child]), end.append(middle), link.append(0)
                    edge[split * letters + letter] = len(start)
                    start.append(i), end.append(n), link.append(0)
                    start[child] = middle
                    edge[split * letters + s[middle]] = child
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - waiting + 1
        self.edge, self.link = edge, link
        return start, end

    def _measured(self, start: list[int], end: list[int]) -> None:
        n, nodes = len(self.s), len(start)
        children: list[list[int]] = [[] for _ in range(nodes)]
        for key, child in self.edge.items():
            children[key // self.letters].append(child)
        parent, depth, low, first, size = ([0] * nodes for _ in range(5))
        leaves, order, waiting = [], [], [0]
        while waiting:
            v = waiting.pop()
            order.append(v)
            first[v] = len(leaves)
            if children[v]:
                below = depth[v]
                for c in children[v]:
                    parent[c], depth[c] = v, below + end[c] - start[c]
                waiting += children[v]
                low[v] = n
            else:
                low[v], size[v] = n - depth[v], 1
                leaves.append(low[v])
        for v in reversed(order[1:]):
            p = parent[v]
            size[p] += size[v]
            if low[v] < low[p]:
                low[p] = low[v]
        self.parent, self.depth, self.low, self.first, self.size, self.leaves = parent, depth, low, first, size, np.array(leaves)

    def tops(self) -> tuple[list[int], list[int]]:
        """By place: its leaf, and the highest node whose string stands there first."""
        leaf, top = [0] * len(self.s), [0] * len(self.s)
        for v in range(1, len(self.parent)):
            i = self.low[v]
            if self.size[v] == 1:
                leaf[i] = v
            if self.low[self.parent[v]] != i or not self.parent[v]:
                top[i] = v
        return leaf, top


class Extensions:
    """How far equal stretches reach, from names of all stretches of 1, 2, 4, ... letters (until all names differ)."""

    def __init__(self, s: np.ndarray) -> None:
        self.names = [np.unique(s, return_inverse=True)[1]]
        while (last := self.names[-1]).size and (step := len(s) - len(last) + 1) < len(last) and last.max() + 1 < len(last):
            self.names.append(np.unique(last[:-step] * len(s) + last[step:], return_inverse=True)[1])

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """By pair of places i < j, the letters that are equal from there on."""
        return self._reach(i, j, 1)

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same for the letters up to these places, going backwards; -1 is before the first."""
        return self._reach(i, j, -1)

    def _reach(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        reached = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            shift = reached if way > 0 else -(reached + step - 1)
            a, b = i + shift, j + shift
            fits = np.flatnonzero((a >= 0) & (b < len(names)))
            reached[fits[names[a[fits]] == names[b[fits]]]] += step
        return reached


def _covering(s: np.ndarray, tree: SuffixTree, top: list[int]) -> list[tuple[int, int]]:
    """(place, period) of squares that cover the leftmost ones of each kind, by place and from the longest.

    A leftmost square whose left half ends in a block holds the block's first
    place in its left half, or the next block's in its right half; else the
    block's earlier copy held it too. Its period is less than both blocks.
    """
    n = len(s)
    borders = [0]
    while borders[-1] < n:
        h = borders[-1]
        borders.append(h + max(1, tree.depth[tree.parent[top[h]]]))
    begins, nexts = np.array(borders[:-1]), np.array(borders[1:])
    afters = np.append(nexts[1:], n)
    own, both = nexts - begins, afters - begins
    periods = lambda counts: np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts) + 1
    k = np.concatenate([periods(own), periods(both)])
    left = np.concatenate([np.repeat(nexts, own), np.repeat(begins, both)])
    left[: own.sum()] -= k[: own.sum()]  # the place in the left half; a period further is that in the right half
    inside = left + k < n
    k, left = k[inside], left[inside]
    reach = Extensions(s)
    ahead, back = reach.ahead(left, left + k), reach.back(left - 1, left + k - 1)
    start = np.maximum(left - back, left - k + 1)
    found = (ahead + back >= k) & (ahead > 0)
    return sorted(set(zip(start[found].tolist(), k[found].tolist(), strict=True)), key=lambda x: (x[0], -x[1]))


def vocabulary(s: list[int]) -> tuple[SuffixTree, set[tuple[int, int]]]:
    """The suffix tree of ``s`` (its last number stands nowhere else) and a (node, length) for each different square: its place is on the edge to the node."""
    tree = SuffixTree(s)
    leaf, top = tree.tops()
    edge, link, letters, parent, depth, low = tree.edge, tree.link, tree.letters, tree.parent, tree.depth, tree.low
    marks: list[tuple[int, int]] = []
    at, node = -1, 0
    for i, k in _covering(np.array(s), tree, top):
        if i != at:
            at, node = i, leaf[i]
        while node != top[i] and depth[parent[node]] >= 2 * k:
            node = parent[node]
        if depth[parent[node]] < 2 * k:  # else an earlier square of the kind stands for it
            marks.append((node, 2 * k))
    known = set(marks)
    for v, length in marks:
        while True:  # the square without its first letter, and that letter again at its end
            i = low[v]
            letter, node = s[i], link[parent[v]]
            child = node
            while depth[node] < length - 1:
                child = edge[node * letters + s[i + 1 + depth[node]]]
                if depth[child] >= length:
                    break
                node = child
            if depth[node] == length - 1:
                child = edge.get(node * letters + letter)
                if child is None:
                    break
            elif s[low[child] + length - 1] != letter:
                break
            v = child
            if (v, length) in known:
                break
            known.add((v, length))
    return tree, known


def all_runs(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all stretches of ``s`` (numbers from 0) that are at least twice their smallest period and can't be longer, by start and period."""
    if not s:
        return []
    tree, squares = vocabulary([*s, max(s) + 1])
    nodes: dict[int, list[int]] = {}
    for v, length in squares:
        nodes.setdefault(length // 2, []).append(v)
    # by place: the last place of the longest run of a shorter period that holds it
    last = np.full(len(s), -1, np.int64)
    low, first, size = (np.array(x) for x in (tree.low, tree.first, tree.size))
    out: list[tuple[int, int, int]] = []
    for period in sorted(nodes):
        own = np.array(nodes[period])
        own = own[last[low[own]] < low[own] + 2 * period - 1]  # the others' halves have a period themselves
        if not len(own):
            continue
        places = np.sort(np.concatenate([tree.leaves[a : a + n] for a, n in zip(first[own].tolist(), size[own].tolist(), strict=True)]))
        cuts = np.flatnonzero(np.diff(places) > 1)
        for a, b in zip(places[np.append(0, cuts + 1)].tolist(), places[np.append(cuts, len(places) - 1)].tolist(), strict=True):
            end = b + 2 * period
            out.append((a, end - a, period))
            np.maximum(last[a:end], end - 1, out=last[a:end])
    return sorted(out, key=lambda r: (r[0], r[2]))


def _stretches(words: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words that can hold a run.

    Inside a run each two neighbouring words stand ``exponent`` - 1 times, a
    period apart; so a run lies whole in a stretch whose neighbours all do.
    What is left is looked at again, each stretch on its own, three times.
    """
    pairs = words[:-1] * (words.max() + 1) + words[1:]
    at = np.arange(len(pairs))
    group = np.zeros(len(pairs), np.int64)
    for _ in range(3):
        if not len(at):
            return []
        names = np.unique(pairs[at], return_inverse=True)[1]
        _, same, count = np.unique(group * len(at) + names, return_inverse=True, return_counts=True)
        kept = count[same] >= exponent - 1
        at = at[kept]
        group = np.cumsum(np.diff(at, prepend=-2) > 1)
        long = np.bincount(group)[group] >= least - 1
        at, group = at[long], group[long]
    cuts = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.append(0, cuts + 1)].tolist(), (at[np.append(cuts, len(at) - 1)] + 2).tolist(), strict=True)) if len(at) else []


def runs_of(words: list[bytes], exponent: int = EXPONENT, least: int = LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``words`` of at least ``least`` words and ``exponent`` (2 or more) periods, by start and period."""
    if len(words) < max(2, least):
        return []
    names: dict[bytes, int] = {}
    numbers = np.array([names.setdefault(w, len(names)) for w in words])
    stretches = _stretches(numbers, exponent, least)
    if not stretches:
        return []
    # one sequence of all stretches, with numbers between them that stand nowhere else
    sequence, place, between = [], [], len(names)
    for a, b in stretches:
        sequence += [numbers[a:b], [between]]
        place += [np.arange(a, b), [-1]]
        between += 1
    small = np.unique(np.concatenate(sequence), return_inverse=True)[1].tolist()
    where = np.concatenate(place).tolist()
    return [(where[a], n, q) for a, n, q in all_runs(small) if n >= max(least, exponent * q)]


def find_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", exponent: int = EXPONENT, least: int = LENGTH) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period, by start and period) and ``collapsed``, the text with one period of each run.

    Words are what lies between blanks, tabs and line ends, numbered from 0.
    A run is a stretch of words of smallest period ``period`` (words that far
    apart are the same) that no neighbouring word extends, of at least
    ``least`` words and ``exponent`` periods. ``collapsed`` joins by one
    space the words that no run holds after its first period.

    Null texts and those without words have no runs and collapse to nothing.
    Equal texts, repeated rows too, get equal values. Texts of any length are
    taken whole; time grows with the words, times their logarithm, memory
    with the longest text. An empty table stays empty; columns of those names
    are replaced, all others kept. Nothing is shuffled.
    """

    @F.arrow_udf("struct<runs: array<struct<start: long, length: long, period: long>>, collapsed: string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows, left = [], []
            for value in texts.cast(pa.binary()):
                words = (value.as_py() or b"").split()  # of bytes: at ASCII white space only
                own = runs_of(words, exponent, least)
                if own:
                    kept = np.ones(len(words), bool)
                    for a, n, q in own:
                        kept[a + q : a + n] = False
                    words = [words[i] for i in np.flatnonzero(kept).tolist()]
                rows.append([{"start": a, "length": n, "period": q} for a, n, q in own])
                left.append(b" ".join(words))
            yield pa.StructArray.from_arrays([pa.array(rows, pa.list_(_RUN)), pa.array(left, pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    both = unused(docs, "found")
    return docs.withColumn(both, found(F.col(f"`{text}`"))).withColumns({runs: F.col(f"{both}.runs"), collapsed: F.col(f"{both}.collapsed")}).drop(both)
