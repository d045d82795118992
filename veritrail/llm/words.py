"""Words of UTF-8 texts as 64-bit hashes, computed on whole Arrow batches.

Words are runs of bytes of a class; classes separate only by ASCII bytes, so
working on bytes equals working on code points. A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GOLDEN = 0x9E3779B97F4A7C15
BASE = np.uint64(0xD6E8FEB86659FD93)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Words are what stands between white space.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words are ASCII letters, digits and all that is not ASCII.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(GOLDEN))[_FOLD]
    _power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(255, BASE)]), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power
    if n > len(_power):
        _power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)
    return _power


def batches(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes of text (one row at least): first row, end, bytes, each row's bounds in them. Null is empty."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def hashes(data: np.ndarray, bounds: np.ndarray, word: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each row's bounds among them. Works through ``step`` bytes at a time, so a text may be of any length."""
    found, starts, at, n = [], [], 0, len(data)
    inner = bounds[1:-1]
    while at < n:
        end = min(n, at + step)
        while end < n and word[data[end]] and word[data[end - 1]]:  # to the end of a word
            more = np.flatnonzero(~word[data[end : end + step]])
            end = end + int(more[0]) if len(more) else min(n, end + step)
        piece = data[at:end]
        cut = inner[np.searchsorted(inner, at, side="right") : np.searchsorted(inner, end)] - at
        inside = word[piece]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[cut] = False
        start = np.flatnonzero(inside & ~before)
        if len(start):
            place = np.flatnonzero(inside)
            first = np.searchsorted(place, start)
            length = np.diff(np.append(first, len(place)))
            power = _powers(int(length.max()))
            with np.errstate(over="ignore"):
                value = _BYTE[piece[place]]
                value *= power[np.arange(len(place)) - np.repeat(first, length)]
                found.append(mix(np.add.reduceat(value, first) + length.astype(np.uint64) * np.uint64(GOLDEN)))
            starts.append(start + at)
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(starts), bounds)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def grams(words: np.ndarray, bounds: np.ndarray, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word sequences with these offsets (0 first) that lie within one row, and each row's bounds among them."""
    span, count = offsets[-1], np.diff(bounds)
    if len(words) <= span:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    out = np.zeros(len(words) - span, np.uint64)
    with np.errstate(over="ignore"):
        for k in offsets:
            out *= BASE
            out += words[k : len(words) - span + k]
        out = mix(out + np.uint64(len(offsets)))
    row = rows_of(bounds)
    return out[row[: len(words) - span] == row[span:]], np.concatenate([[0], np.cumsum(np.maximum(count - span, 0))])
