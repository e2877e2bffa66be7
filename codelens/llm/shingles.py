"""Words and word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together, at least; a longer text goes alone. Arrays of some 40 times as many bytes are made of them.
BLOCK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and at a task's end what Arrow keeps of freed memory goes back: workers live on."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _bytes(plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, A-Z as a-z, and which bytes stand between words."""
    at = np.arange(256)
    lower = np.where((at >= 65) & (at <= 90), at + 32, at).astype(np.uint64)
    space = (at == 32) | ((at >= 9) & (at <= 13))
    if plain:
        space |= (at < 128) & ~(((at >= 48) & (at <= 57)) | ((at >= 65) & (at <= 90)) | ((at >= 97) & (at <= 122)))
    return mix(lower * _ODD + np.uint64(1)), space


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = int(_ODD)
            inverse = pow(base, -1, 1 << 64)
            for name, b in (("up", base), ("down", inverse)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


_POWERS = _Powers()


def words(data: np.ndarray, ends: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of texts that lie end to end in ``data`` (UTF-8), and how many words end within each text.

    Words are runs without white space (0x20, 0x09 to 0x0D), A-Z as a-z;
    ``plain`` leaves out all other ASCII but letters and digits, too.
    ``ends`` holds each text's end; a word never goes over one. The second
    array is cumulative, as ``ends`` is.
    """
    values, space = _bytes(plain)
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~space[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = ends[:-1][ends[:-1] < n]
    starts[cut] = inside[cut]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = cut[cut > 0] - 1
    stops[last] = inside[last]
    first, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    up, down = _POWERS.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=total[1:])
    found = mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64) * _ODD)
    return found, np.searchsorted(first, ends, side="left")


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, number of rows, data, ends) of stretches of a string column; null texts are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        to = min(to, n)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; one with fewer words than ``width``, but some, is one shingle."""
    weights = [mix(np.array([k + 1], np.uint64) * _ODD)[0] | np.uint64(1) for k in range(width)]
    for first, rows, data, ends in blocks(column):
        hashes, counts = words(data, ends)
        n = len(hashes)
        whole = np.zeros(max(0, n - width + 1), np.uint64)
        for k, w in enumerate(weights):
            whole += hashes[k : k + len(whole)] * w
        whole = mix(whole)
        begin = 0
        for row in range(rows):
            stop = int(counts[row])
            if stop - begin >= width:
                yield first + row, np.unique(whole[begin : stop - width + 1])
            elif stop > begin:
                own = hashes[begin:stop] * np.array(weights[: stop - begin])
                yield first + row, mix(own.sum(keepdims=True) + np.uint64(stop - begin))
            else:
                yield first + row, whole[:0]
            begin = stop
