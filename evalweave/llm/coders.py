"""Token ids of whole Arrow text columns, about a megabyte of text at a time."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from evalweave.llm.words import chunks

CHUNK = 1_000_000  # bytes of text coded at once; a longer text is coded alone

#: The ids of some texts, one after another, and how many each text has.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the
    others for the characters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in lists]) if lists else np.zeros(0, np.int32)
    return flat, np.array([len(x) for x in lists], dtype=np.int64)


def byte_bpe(model: str, special_as_text: bool = False) -> Encode:
    """Ids under the text of a `tokenizers` file, without special tokens being added.

    Where the file is plain byte-level BPE whose tokens are numbered in the order of its merges,
    its vocabulary serves as ranks and the ids come from the faster coder of such ranks; any
    other file is left to its own library.
    """
    ranks = _ranks(json.loads(model))
    if ranks is None:
        tokenizer = Tokenizer.from_str(model)
        tokenizer.encode_special_tokens = special_as_text
        return lambda texts: joined([e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
    plain, special = ranks
    coder = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens={} if special_as_text else special)
    return lambda texts: joined([coder.encode_to_numpy(t, allowed_special="all") for t in texts])


def _ranks(model: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Token bytes -> id, and the special tokens, if ids are ranks; else None."""
    bpe, before, added = model["model"], model.get("pre_tokenizer") or {}, model.get("added_tokens") or []
    plain = (
        bpe.get("type") == "BPE" and not model.get("normalizer") and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space") and before.get("use_regex", True)
        and not any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    special = {a["content"]: a["id"] for a in added}
    to, vocab = byte_alphabet(), {t: i for t, i in bpe.get("vocab", {}).items() if t not in special} if plain else {}
    if not plain or not all(c in to for t in vocab for c in t):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
    made = [vocab.get(a + b) for a, b in merges]
    if made != list(range(256, 256 + len(merges))) or sorted(vocab.values()) != list(range(256 + len(merges))):
        return None
    return {bytes(to[c] for c in t): i for t, i in vocab.items()}, special


def pieces(model: SentencePieceProcessor) -> Encode:
    """Ids under a piece model, which puts a blank before each text."""
    return lambda texts: joined(model.encode(texts, num_threads=1))


def coded_rows(column: pa.Array, *encoders: Encode) -> Iterator[tuple]:
    """Of runs of rows: first row, last + 1, bytes, their offsets, and per encoder (ids, row borders).

    NULL counts as empty.
    """
    for lo, hi, body, at in chunks(column, CHUNK):
        texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        coded = (encode(texts) for encode in encoders)
        yield lo, hi, body, at, [(flat, np.concatenate(([0], np.cumsum(n)))) for flat, n in coded]


def id_type(vocabulary: int) -> str:
    """Little-endian unsigned ids, of two bytes where the vocabulary allows it."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def binary(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """A flat array's bytes, cut at the offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def row_runs(batch: pa.RecordBatch, size: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs whose sizes add up to about `most`."""
    total, lo = np.cumsum(size), 0
    while lo < batch.num_rows:
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
