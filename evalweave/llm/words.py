"""Words and shingles of whole Arrow text batches as 64-bit hashes.

A column of texts is one byte buffer with offsets. Word borders, hashes and
shingles are computed over that buffer with NumPy, half a megabyte at a time, so
no Python object is made per word and memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 500_000  # bytes of text worked on at once; a longer text is one chunk
SHINGLE = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (SplitMix64's)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_PLACES = mix(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64)) | np.uint64(1)

#: Word bytes of the two definitions in use; A-Z are lower-cased first.
BLANK_SEPARATED = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
LETTERS_DIGITS = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80 for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; NULL counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return body, at


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of row runs of about `most` bytes."""
    body, at = text_buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi, body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_hashes(body: np.ndarray, at: np.ndarray, kind: np.ndarray, latin: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and the border of each row in that list.

    A-Z are lower-cased; with `latin` also the accented capitals of two bytes from C3 80 on.
    """
    inside = kind[body]
    lower = _LOWER[body]
    if latin and len(body):
        capital = (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97) & (body[:-1] == 0xC3)
        lower[1:][capital] += 0x20
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    before[begins] = False  # a word ends with its text
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    where = np.flatnonzero(inside)
    first = np.searchsorted(where, starts)
    size = np.diff(np.append(first, len(where)))
    place = np.arange(len(where)) - np.repeat(first, size)
    parts = _BYTES[lower[where]] * _powers(int(size.max()))[place]
    return mix(np.add.reduceat(parts, first)), np.searchsorted(starts, at)


def shingle_sets(body: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct 5-word shingles (int64) of each row.

    Fewer words: the whole sequence is the one shingle; no words: an empty array.
    """
    words, row = word_hashes(body, at, BLANK_SEPARATED)
    whole = len(words) - SHINGLE + 1
    if whole > 0:
        runs = words[:whole] * _PLACES[0]
        for k in range(1, SHINGLE):
            runs = runs + words[k : k + whole] * _PLACES[k]
        runs = mix(runs).view(np.int64)
    for a, b in zip(row[:-1], row[1:], strict=True):
        if b - a >= SHINGLE:
            u = np.sort(runs[a : b - SHINGLE + 1])
            if len(u) > 1:
                u = u[np.concatenate(([True], u[1:] != u[:-1]))]
            yield u
        elif b > a:
            short = (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([short], dtype=np.uint64)).view(np.int64)
        else:
            yield np.zeros(0, dtype=np.int64)
