"""Vectorised helpers over the text buffers of Arrow batches, shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledger_spark.session import local_frame

U64 = np.uint64
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240531).integers(1, 1 << 63, 256, dtype=U64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
WINDOW = 1 << 18


def release() -> None:
    """Give freed memory back to the system; a Python worker is used again by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that releases memory after every few batches and at its end."""
    def wrapped(batches: Iterator) -> Iterator:
        for i, out in enumerate(run(batches)):
            yield out
            del out
            if i % 8 == 7:
                release()
        release()

    return wrapped


def least_texts(rows: DataFrame, most: int, most_bytes: int | None = None) -> list[tuple[str, str]]:
    """(of, text): of each class `of` of `rows` (of, text) the `most` different texts of the least hashes, by class and hash.

    Classes are few.  Different hashes are counted first, and a bound on the hash lets a few more than `most` of each
    class through, which are read once each; should fewer come, the bound is widened.  Neither ids nor repeated texts have a say.
    With `most_bytes` a class's texts end before the one that passes it, but for the first; sizes are looked at first,
    so no other texts come to the driver.
    """
    size = 1 << 30
    hashed = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.pmod("hash", F.lit(size)))
    sizes = dict(tuple(r) for r in hashed.select("of", "hash").distinct().groupBy("of").count().collect())
    out: list[tuple[str, str]] = []
    room = most + 8 * most ** 0.5 + 16
    while sizes:
        below = F.coalesce(*[F.when(F.col("of") == k, F.lit(math.ceil(size * min(1.0, room / n)))) for k, n in sizes.items()])
        near = hashed.where(F.col("place") < below)
        if most_bytes is not None:
            near = near.join(F.broadcast(_within(near, most, most_bytes)), ["of", "hash"], "left_semi")
        picked = near.groupBy("of", "place", "hash").agg(F.min("text").alias("text")).collect()
        by: dict[str, list] = {}
        for r in sorted(picked, key=lambda r: (r["of"], r["place"], r["hash"])):
            by.setdefault(r["of"], []).append(r["text"])
        for k in [k for k, n in sizes.items() if len(by.get(k, ())) >= (min(most, n) if most_bytes is None else 1)]:
            out += [(k, text) for text in by[k][:most]]
            del sizes[k]
        room *= 2
    return sorted(out, key=lambda r: r[0])


def _within(near: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """(of, hash) of the first texts of each class whose bytes stay within a bound; some hundred rows a class."""
    found: dict[str, list] = {}
    for r in near.groupBy("of", "place", "hash").agg(F.max(F.octet_length("text")).alias("size")).collect():
        found.setdefault(r["of"], []).append((r["place"], r["hash"], r["size"]))
    kept = []
    for k, texts in found.items():
        left = most_bytes
        for i, (_, h, n) in enumerate(sorted(texts)[:most]):
            left -= n
            if i and left < 0:
                break
            kept.append((k, h))
    return local_frame(near.sparkSession, ["of", "hash"], kept)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row; nulls are empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    sizes = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = sizes[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return raw[first:offsets[-1]] if len(offsets) else raw[:0], offsets - first


def row_slices(offsets: np.ndarray, most: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes together; a longer row stands alone."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, rows)
        at = min(to, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_spans(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and the number of words of each row."""
    size = len(buffer)
    inside = ~_SEPARATORS[buffer]
    edge = np.zeros(size + 1, bool)
    edge[offsets[:-1]] = True
    edge[size] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:size]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:size]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < size:
        n = max(size, WINDOW + 4096)
        up, down = np.full(n, _BASE, U64), np.full(n, _BASE_INVERSE, U64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if n <= 2 * WINDOW:
            _POWERS[0] = have
    return have


def span_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint spans, in windows of about `WINDOW` bytes."""
    out = np.empty(len(start), U64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + WINDOW, "right")))
        low, high = int(start[at]), int(end[to - 1])
        up, down = _powers(high - low + 1)
        sums = np.zeros(high - low + 1, U64)
        np.cumsum(_BYTE_VALUES[buffer[low:high]] * up[:high - low], out=sums[1:])
        s, e = start[at:to] - low, end[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
        at = to
    return mix(out)


def ascii_lower(buffer: np.ndarray) -> np.ndarray:
    return _ASCII_LOWER[buffer]


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of `words` words, letters A-Z in lower case.

    A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    factors = [U64(x) for x in np.random.default_rng(7).integers(1, 1 << 62, words + 1) * 2 + 1]
    buffer, offsets = text_buffer(column)
    for low, high in row_slices(offsets):
        part = ascii_lower(buffer[offsets[low]:offsets[high]])
        start, end, counts = word_spans(part, offsets[low:high + 1] - offsets[low])
        hashes = span_hashes(part, start, end)
        rolled = np.zeros(max(0, len(hashes) - words + 1), U64)
        for k in range(words):
            rolled += hashes[k:len(hashes) - words + 1 + k] * factors[k]
        rolled = mix(rolled)
        at = 0
        for n in counts:
            if n >= words:
                yield np.unique(rolled[at:at + n - words + 1])
            elif n:
                short = sum((hashes[at + k:at + k + 1] * factors[k] for k in range(n)), np.zeros(1, U64))
                yield mix(short + U64(n) * factors[words])
            else:
                yield np.zeros(0, U64)
            at += n
