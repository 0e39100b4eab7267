"""Reproducible pseudo-random values.

The value depends only on its key, so a task that runs again gives the same
answer, and any engine with md5 can repeat it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIONS = 1 << 18  # positions of one record batch that a task gives back, but for one long row
CHUNK = 1 << 14  # positions hashed at once: their words stay in the processor's cache
BLOCK = 55  # bytes of text in one md5 block


def hash_uniform(*parts) -> Column:
    """A uniform value in [0, 1) from the parts: 32 bits of their md5."""
    key = F.concat_ws("|", *[_text(p) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def _text(p) -> Column:
    return (p if isinstance(p, Column) else F.lit(p)).cast("string")


def text_before(parts) -> Column:
    """What stands before the position in the text that is hashed; parts that are NULL are left out."""
    return F.concat_ws("|", *[_text(p) for p in parts], F.lit(""))


def hash_uniforms(n: Column, **draws: tuple) -> Column:
    """`hash_uniform(*parts, i)` for i = 0 .. n - 1, a struct of one field per draw (name=parts).

    An array expression builds and hashes one text per position; here a task hashes the
    positions of many rows at once, in Arrow batches. NULL where n is.
    """
    names = list(draws)

    def values(start: list[pa.Array], size: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(hashes(s, size) / 2.0**32) for s in start], names)

    fields = ", ".join(f"`{name}`: DOUBLE" for name in names)
    return per_position(f"array<struct<{fields}>>", values)(n.cast("int"), *(text_before(p) for p in draws.values()))


def hash_least(n: Column, k: Column, *parts) -> Column:
    """Of positions 0 .. n - 1, whether `hash_uniform(*parts, i)` is among the k least (ties: the first)."""

    def marks(columns: list[pa.Array], size: np.ndarray) -> pa.Array:
        start, many = columns
        border = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(border[-1]) - np.repeat(border[:-1], size)
        rank = hashes(start, size).astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)
        least = np.zeros(len(rank), bool)
        for lo, hi, m in zip(border[:-1], border[1:], many.to_numpy(zero_copy_only=False)):
            if 0 < m <= hi - lo:
                own = rank[lo:hi]
                least[lo:hi] = own <= np.partition(own, m - 1)[m - 1]
        return pa.array(least)

    return per_position("array<boolean>", marks)(n.cast("int"), text_before(parts), k.cast("int"))


def per_position(kind: str, values: Callable[[list[pa.Array], np.ndarray], pa.Array]) -> Callable[..., Column]:
    """A call that gives each row a list of its first argument's length; `values` makes those of some rows."""

    def work(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for n, *rest in batches:
            size = np.maximum(n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
            border = np.concatenate(([0], np.cumsum(size)))
            lo = 0
            while lo < len(size):
                hi = max(lo + 1, int(np.searchsorted(border, border[lo] + POSITIONS, "right")) - 1)
                flat = values([c.slice(lo, hi - lo) for c in rest], size[lo:hi])
                ends = pa.array((border[lo : hi + 1] - border[lo]).astype(np.int32))
                yield pa.ListArray.from_arrays(ends, flat, mask=n.slice(lo, hi - lo).is_null())
                lo = hi

    # Not deterministic: the optimizer leaves the call where it is and never repeats it.
    return F.arrow_udf(work, kind).asNondeterministic()


def hashes(start: pa.Array, size: np.ndarray) -> np.ndarray:
    """The first 32 bits of md5(start + position), for the positions of all rows."""
    border = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(border[-1], np.uint32)
    digits = len(str(max(int(size.max(initial=0)) - 1, 0)))
    texts = [t.encode() for t in start.to_pylist()]
    long = max(map(len, texts), default=0)
    if long + digits > BLOCK:
        for t, lo, n in zip(texts, border, size):
            for i in range(n):
                out[lo + i] = int.from_bytes(hashlib.md5(t + b"%d" % i, usedforsecurity=False).digest()[:4], "big")
        return out
    n_words = (long + digits) // 4 + 1
    heads = np.frombuffer(b"".join(t.ljust(4 * n_words, b"\0") for t in texts), np.uint8).reshape(len(texts), 4 * n_words)
    length = np.array([len(t) for t in texts], np.int64)
    for lo in range(0, len(out), CHUNK):
        hi = min(lo + CHUNK, len(out))
        first, last = np.searchsorted(border, (lo, hi - 1), "right") - 1
        rows = np.arange(first, last + 1)
        row = np.repeat(rows, np.minimum(border[rows + 1], hi) - np.maximum(border[rows], lo))
        place = (np.arange(lo, hi) - border[row]).astype(np.uint32)
        width = np.ones(hi - lo, np.int64)
        for d in range(1, digits):
            width += place >= 10**d
        text = heads[row]
        flat, end = text.reshape(-1), np.arange(hi - lo) * text.shape[1] + length[row] + width
        flat[end] = 0x80
        for d in range(digits):
            has = slice(None) if d == 0 else np.flatnonzero(width > d)
            flat[end[has] - 1 - d] = 48 + place[has] % 10
            place //= 10
        words = np.ascontiguousarray(text.view("<u4").T)
        out[lo:hi] = _md5_first(words, ((length[row] + width) * 8).astype(np.uint32))
    return out.byteswap()


_TURNS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


def _md5_first(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The first word of the md5 (RFC 1321) of texts of one block, given by columns of words and their bits."""
    a, b, c, d = (np.full(len(bits), v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    t, high = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, t)
            t &= b
            t ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, t)
            t &= d
            t ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, t)
            t ^= d
        else:
            g = 7 * i % 16
            np.invert(d, t)
            t |= b
            t ^= c
        t += a
        t += _SINES[i]
        if g < len(words):
            t += words[g]
        elif g == 14:
            t += bits
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(t, np.uint32(turn), high)
        t >>= np.uint32(32 - turn)
        t |= high
        t += b
        a, d, c, b, t = d, c, b, t, a
    return a + np.uint32(0x67452301)
