"""Byte-level BPE encoding and decoding.

Every match of the pattern is encoded on its own. A segment tree over its byte
positions holds, at the root, the leftmost pair of the lowest rank. A merge takes that
pair, links its neighbours past it and changes three leaves, each in as many steps as
the tree is deep; so one match of n bytes costs n log n, however long it is.

The rank file is read once on the driver and broadcast (its size is that of a
vocabulary). A task keeps a memo of matches already encoded, bounded in bytes, and drops it
when it ends.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from evalweave.llm.frugal import frugal, small_batches

MEMO = 200_000_000  # bytes of matches a task remembers before it starts afresh
SHORT = 200  # letters of a match worth remembering
_ENTRY = 200  # bytes that the objects of an entry take besides its text and ids
_SHIFT, _NONE = 32, 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, of a file with one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Encoder(dict):
    """match -> its ids (the bytes of int32 values), worked out on first use."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {
            ranks[t[:k]] << 20 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        }
        self.bytes = {r: t for t, r in ranks.items()}
        self.held = 0

    def __missing__(self, match: str) -> bytes:
        piece = match.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(piece)
        ids = array("i", (whole,) if whole is not None else self.merge(piece)).tobytes()
        if len(match) <= SHORT:
            self[match] = ids
            self.held += _ENTRY + len(piece) + len(ids)
            if self.held > MEMO:
                self.clear()
                self.held = 0
        return ids

    def merge(self, piece: bytes) -> list[int]:
        n, pair = len(piece), self.pairs.get
        token = [self.single[b] for b in piece]
        leaf = 1 << (n - 1).bit_length() if n > 1 else 1
        tree = [_NONE] * (2 * leaf)
        for i in range(n - 1):
            r = pair(token[i] << 20 | token[i + 1])
            if r is not None:
                tree[leaf + i] = r << _SHIFT | i
        for k in range(leaf - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := tree[1]) != _NONE:
            i, rank = least & (1 << _SHIFT) - 1, least >> _SHIFT
            gone = right[i]
            after = right[gone]
            token[i], token[gone], right[i] = rank, -1, after
            changes = [(gone, _NONE)]
            r = None
            if after < n:
                left[after] = i
                r = pair(rank << 20 | token[after])
            changes.append((i, _NONE if r is None else r << _SHIFT | i))
            before = left[i]
            if before >= 0:
                r = pair(token[before] << 20 | rank)
                changes.append((before, _NONE if r is None else r << _SHIFT | before))
            for place, key in changes:
                k = leaf + place
                if tree[k] != key:
                    tree[k] = key
                    while k > 1:
                        other = tree[k ^ 1]
                        key = key if key < other else other
                        k >>= 1
                        if tree[k] == key:
                            break
                        tree[k] = key
        return [t for t in token if t >= 0]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.find(text))), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, ids array<int> and decoded binary (the bytes that the ids stand for).

    NULL or empty texts have no ids. Repeated rows stay; an empty table gives an empty
    result; other columns are ignored. A text needs memory in proportion to its length.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = docs.select(*keep, docs[text].cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)  # the task's own, gone with it
        for batch in batches:
            lo, size, ids, cut, decoded = 0, 0, [], [0], []

            def out(lo: int, hi: int) -> pa.RecordBatch:
                kept = [batch.column(k).slice(lo, hi - lo) for k in range(len(keep))]
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                return pa.RecordBatch.from_arrays(
                    [*kept, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), flat), pa.array(decoded, pa.binary())],
                    names=[*keep, "ids", "decoded"],
                )

            for row, value in enumerate(batch.column(len(keep))):
                found = encoder.encode(value.as_py() or "")
                back = encoder.decode(found)
                ids.append(found)
                cut.append(cut[-1] + len(found))
                decoded.append(back)
                size += len(back)
                if size > 4_000_000:
                    yield out(lo, row + 1)
                    lo, size, ids, cut, decoded = row + 1, 0, [], [0], []
            if lo < batch.num_rows:
                yield out(lo, batch.num_rows)

    return rows.mapInArrow(frugal(run), f"{schema}, ids array<int>, decoded binary")
