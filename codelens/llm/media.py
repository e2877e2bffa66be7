"""Media columns: payloads as greyscale PNG in a binary column, read back and hashed."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Bytes of compressed data in one IDAT chunk, at most.
IDAT = 1 << 20


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 3) -> bytes:
    """An 8-bit grey PNG, 64 samples wide; the length must be a positive multiple of 64.

    All rows take one filter of none, sub and up: the one whose residues are
    least in absolute sum.
    """
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload's length must be a positive multiple of 64")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    kind, best = min(enumerate((rows, sub, up)), key=lambda x: int(np.abs(x[1].view(np.int8).astype(np.int16)).sum()))
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, best
    data = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", data[i : i + IDAT]) for i in range(0, len(data), IDAT)) + _chunk(b"IEND", b"")


def chunks(stored: bytes) -> list[tuple[bytes, bytes]]:
    """(kind, data) of each chunk. Raises ValueError at a wrong signature, length or checksum."""
    if not stored.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    found, at = [], len(SIGNATURE)
    while at < len(stored):
        if at + 12 > len(stored):
            raise ValueError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", stored, at)
        kind, data = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if at + 12 + n > len(stored) or zlib.crc32(kind + data) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError(f"the checksum of {kind!r} is wrong")
        found.append((kind, data))
        at += 12 + n
        if kind == b"IEND":
            break
    if not found or found[-1][0] != b"IEND" or at != len(stored):
        raise ValueError("it doesn't end with IEND")
    return found


def _unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The samples of filtered rows, one byte a pixel. Runs of rows with the same filter are undone at once where that can be."""
    out = np.empty_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges], [*edges, len(rows)], strict=True):
        kind, part = kinds[a], rows[a:b]
        if kind == 0:
            out[a:b] = part
        elif kind == 1:
            out[a:b] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(part, axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for y in range(a, b):
                line, before = [0] * rows.shape[1], above.tolist()
                left = corner = 0
                for x, v in enumerate(rows[y].tolist()):
                    up = before[x]
                    if kind == 3:
                        guess = (left + up) >> 1
                    else:
                        far = left + up - corner
                        d = (abs(far - left), abs(far - up), abs(far - corner))
                        guess = left if d[0] <= d[1] and d[0] <= d[2] else up if d[1] <= d[2] else corner
                    left, corner = (v + guess) & 255, up
                    line[x] = left
                out[y] = line
                above = out[y]
        else:
            raise ValueError(f"unknown filter {kind}")
        above = out[b - 1]
    return out


def decode_png(stored: bytes) -> np.ndarray:
    """Rows of samples of an 8-bit grey PNG that isn't interlaced. Raises ValueError for anything else."""
    parts = chunks(stored)
    if parts[0][0] != b"IHDR" or len(parts[0][1]) != 13:
        raise ValueError("it doesn't begin with IHDR")
    width, height, *form = struct.unpack(">IIBBBBB", parts[0][1])
    if form != [8, 0, 0, 0, 0] or not width or not height:
        raise ValueError("not an 8-bit grey PNG")
    try:
        data = np.frombuffer(zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT")), np.uint8)
    except zlib.error as e:
        raise ValueError("its data can't be inflated") from e
    if data.size != height * (width + 1):
        raise ValueError("its data has another size")
    lines = data.reshape(height, width + 1)
    return _unfiltered(lines[:, 0], lines[:, 1:])


@lru_cache(maxsize=1)
def _cosines(n: int = 32, low: int = 8) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


def cosine_hash(rows: np.ndarray) -> str:
    """16 hex digits: signs, against their median, of the 8 x 8 lowest frequencies of the picture shrunk to 32 x 32."""
    height, width = rows.shape
    small = rows.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        at = np.arange(32) * size // 32
        if size >= 32:
            n = np.diff([*at, size])
            small = np.add.reduceat(small, at, axis=axis) / (n[:, None] if axis == 0 else n)
        else:
            small = np.take(small, at, axis=axis)
    c = _cosines()
    low = np.round(c @ small @ c.T, 6).ravel()
    return f"{int(''.join('1' if x else '0' for x in low > np.median(low[1:])), 2):016x}"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 filled up with zero bytes to a positive multiple of 64, and its length before that."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH), len(raw)


MEDIA = "media binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", with_media: bool = True) -> DataFrame:
    """Each row's text as PNG in ``media``, and what reading that back gives: lengths, digests and ``feature``, the cosine hash.

    Null and empty texts are 64 zero bytes. Equal texts give equal values;
    texts of any length are one picture each; repeated rows stay, an empty
    table stays empty; other columns are left out. ``with_media=False``
    leaves the pictures out of the result. Nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()
    fields = [f.split()[0] for f in MEDIA.split(", ")]
    keep = [f for f in MEDIA.split(", ") if with_media or not f.startswith("media binary")]
    types = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}

    def one(x: str | None) -> tuple:
        payload, n = payload_of(x)
        stored = encode_png(payload)
        rows = decode_png(stored)
        back = rows.tobytes()
        return stored, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(rows)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                columns = dict(zip(fields, zip(*(one(x) for x in b.column(1).to_pylist()), strict=True), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(columns[f.split()[0]], types[f.split()[1]]) for f in keep]], [key, *[f.split()[0] for f in keep]])

    return docs.select(key, text).mapInArrow(made, f"`{key}` {kind}, " + ", ".join(keep))
