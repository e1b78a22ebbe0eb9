"""Shared pieces of the training-data operators."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

_NOT_WORD = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """NFKC, lower case, nothing but letters, ideographs and digits. NULL folds to ''."""
    if not text:
        return ""
    return _NOT_WORD.sub("", unicodedata.normalize("NFKC", text).lower())


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of ``texts`` in one array, and the offsets at which each text starts (one more than texts)."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, offsets


def gram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-character sequences (n <= 3) of each text, as exact 64-bit values.

    Returns the values, the index of the text each belongs to (ascending), and the size of each text's set.
    """
    points, offsets = code_points(texts)
    if len(points) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    if len(texts) <= 1 << 16 and points.max() < 1 << 16:  # one 64-bit key holds text and characters, and sorts fast
        inside = of[: len(points) - n + 1] == of[n - 1 :]
        key = of[: len(inside)].astype(np.uint64) << np.uint64(48)
        for k in range(n):
            key |= points[k : len(inside) + k].astype(np.uint64) << np.uint64(16 * (n - 1 - k))
        key = np.sort(key[inside])
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        of = (key >> np.uint64(48)).astype(np.int64)
        value = np.zeros(len(key), np.uint64)
        for k in range(n):
            value = (value << np.uint64(21)) | ((key >> np.uint64(16 * (n - 1 - k))) & np.uint64(0xFFFF))
        return value, of, np.bincount(of, minlength=len(texts))
    wide = points.astype(np.uint64)
    value = np.zeros(len(wide) - n + 1, np.uint64)
    for k in range(n):
        value = (value << np.uint64(21)) | wide[k : len(wide) - n + 1 + k]
    inside = of[: len(value)] == of[n - 1 :]
    value, of = value[inside], of[: len(value)][inside]
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    if len(value):
        first = np.concatenate([[True], (value[1:] != value[:-1]) | (of[1:] != of[:-1])])
        value, of = value[first], of[first]
    return value, of, np.bincount(of, minlength=len(texts))


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of an Arrow column; NULL becomes ''."""
    return [x or "" for x in column.to_pylist()]


GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed_hash(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit mix of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (values ^ np.uint64(salt * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)) * GOLD
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def histogram(df, count, bits: int, rows: int = 1):
    """Sum over all batches of ``count(batch) -> int array (rows, 2**bits)``; comes to the driver as one array of that fixed size.

    Every task adds up what it reads and passes on slices, so that no task ever gets more than one slice of each task.
    """
    size, slices = 1 << bits, 16

    def partial(batches):
        total = np.zeros((rows, size), np.int64)
        for b in batches:
            total += count(b)
        parts = np.split(total, slices, axis=1)
        used = [k for k in range(slices) if parts[k].any()]
        yield pa.record_batch({"slice": pa.array(used, pa.int32()), "blob": pa.array([_packed(parts[k]) for k in used], pa.binary())})

    def summed(t: pa.Table) -> pa.Table:
        total = sum(_unpacked(x) for x in t["blob"].to_pylist())
        return pa.table({"slice": t["slice"][:1], "blob": pa.array([_packed(total)], pa.binary())})

    schema = "slice int, blob binary"
    out = np.zeros((rows, size), np.int64)
    for r in df.mapInArrow(partial, schema).groupBy("slice").applyInArrow(summed, schema).collect():
        width = size // slices
        out[:, r["slice"] * width : (r["slice"] + 1) * width] = _unpacked(r["blob"]).reshape(rows, width)
    return out


def hot_join(rows, table, keys: list[str], count: str, most: int = 50_000):
    """Inner join of ``rows`` with one row for each key, whose number of rows stands in ``count``.

    Keys of more than ``most`` rows are at most a ``most``-th as many as all rows; they are counted and sent to all tasks, so that no
    task gets all rows of a hot key. The others are joined by key.
    """
    from sedgewren.session import small

    hot = small(table.where(F.col(count) > most))
    usual = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col(count) <= most), keys)
    return rows.join(hot, keys).unionByName(usual)


def _packed(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpacked(b: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.int64)


def bounded(texts: list[str], chars: int = 400_000):
    """Cut a list of texts into lists of about ``chars`` characters, so that arrays over them stay small."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part
