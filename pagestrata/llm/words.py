"""Vectorised words, word hashes and shingle sets of whole texts.

Words are the maximal runs of code points other than U+0020 and U+0009-U+000D.
Those separators are single bytes in UTF-8, so texts are cut as bytes: one pass
of numpy over the Arrow buffer of a batch, a slice of whole texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
SLICE_BYTES = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _UNBASE)):
                full = np.full(n, base, dtype=np.uint64)
                full[0] = 1
                setattr(cls, name, np.multiply.accumulate(full))
        return cls.up[:n], cls.down[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; a null is an empty text."""
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if data is None or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8), at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a slice of its own."""
    rows, start = len(offsets) - 1, 0
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def word_bounds(data: np.ndarray, at: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of `data`, and the first word of each text.

    `at`: offsets of the texts in `data`, from 0 to len(data). `separator`: by byte.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    gap = separator[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    before = np.ones(n, dtype=bool)
    before[1:] = gap[:-1]
    after = np.ones(n, dtype=bool)
    after[:-1] = gap[1:]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Powers.upto(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LOWER[data] * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words; run i starts at word i."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * _BASE + hashes[k : k + n]
    return mix(out)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, ascending.

    A text of 1 to size-1 words has its whole word sequence as the one shingle; a
    null or wordless text has none.
    """
    data, offsets = text_buffer(column)
    for a, b in slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_bounds(part, at)
        hashes = word_hashes(part, starts, ends)
        runs = shingle_hashes(hashes, size)
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= size:
                found = np.sort(runs[lo : hi - size + 1])
                keep = np.ones(len(found), dtype=bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            elif hi > lo:
                whole = np.uint64(hi - lo)
                with np.errstate(over="ignore"):
                    for h in hashes[lo:hi]:
                        whole = whole * _BASE + h
                yield mix(np.array([whole], dtype=np.uint64))
            else:
                yield np.zeros(0, np.uint64)
