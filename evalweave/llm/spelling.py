"""Spelling variants: words one inserted, deleted or replaced letter apart, and their usual form.

Words are counted by letter: the squared distance of two words' letter counts is at most
two if one letter separates them. Blocks are words of one length and of equal counts in a
few classes of letters; only the same, an adjacent and the next longer block can hold near
words. Blocks are cut into tiles of a bounded number of letters, one NumPy product of two
tiles' letter counts gives all squared distances between them, and the pairs that are left
are compared letter by letter. No pair of words is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.sources.scratch import materialize

# The letters of a word, and the thresholds of the words that count.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2

ALPHABET = 26 + 64  # a-z, then U+00C0 to U+00FF
TILE = 16_384  # letters of a tile
ROWS = 512  # rows of a product worked on at once
CHECKED = 65_536  # pairs compared letter by letter at once
FLOAT32_LENGTH = 2_048  # letters up to which products are exact in 32 bits

# ---- words ------------------------------------------------------------------------


def runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([{LETTERS}]+)"), F.lit(1))


def lowered(word: Column) -> Column:
    """A-Z alone in lower case; most words are ASCII, where that is lower()."""
    ascii_only = F.octet_length(word) == F.length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def thinned(key: Column, word: Column, every: int = 97) -> Column:
    """The word, or where the checksum of key and word is divisible by `every`, one letter less."""
    sum_ = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(sum_, F.length(word).cast("bigint")).cast("int")
    less = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(F.pmod(sum_, F.lit(every)) == 0, less).otherwise(word)


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of whole texts with enough letters that occur often enough.

    NULL and empty texts have none, and a NULL key reads as an empty one; repeated rows count again.
    """
    words = docs.select(F.col(key).alias("key"), F.explode(runs(F.col(text).cast("string"))).alias("word"))
    words = words.select("key", lowered(F.col("word")).alias("word")).select(thinned(F.col("key"), F.col("word")).alias("word"))
    counts = words.filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


# ---- blocks and tiles ----------------------------------------------------------------


def letter_classes(words: DataFrame, rows: int) -> list[str]:
    """The letters dealt into classes of about equal weight; more classes for more words."""
    k = max(2, min(10, round(math.log2(rows + 2) / 3)))
    letters = words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    order = [r["c"] for r in letters.orderBy(F.desc("n"), "c").collect()]  # ALPHABET rows at most
    turns = [*range(k), *reversed(range(k))]
    return ["".join(c for i, c in enumerate(order) if turns[i % (2 * k)] == j) for j in range(k)]


def tiles(words: DataFrame, classes: list[str]) -> DataFrame:
    """block (letters of each class), tile, words: sorted structs of word and n."""
    counts = [(F.length("word") - F.length(F.translate("word", c, ""))).cast("int") if c else F.lit(0) for c in classes]
    rows = words.select("word", "n", F.array(*counts).alias("block"))
    sizes = rows.groupBy("block").agg(F.ceil(F.sum(F.length("word")) / TILE).alias("tiles"))
    placed = rows.join(sizes, "block").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")))
    return placed.groupBy("block", "tile").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("words"))


def neighbours(block: Column, k: int) -> Column:
    """The blocks to compare a block with, each pair of blocks once: itself, one letter moved
    to a later class, and one letter more.
    """
    def moved(change: dict[int, int]) -> Column:
        return F.array(*[block[i] + F.lit(change.get(i, 0)) for i in range(k)])

    same = [F.when(block[c] > 0, moved({c: -1, d: 1})) for c in range(k) for d in range(c + 1, k)]
    longer = [moved({c: 1}) for c in range(k)]
    return F.filter(F.array(block, *same, *longer), lambda x: x.isNotNull())


# ---- one pair of tiles ------------------------------------------------------------------


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.array(words, dtype=f"<U{len(words[0])}").view("<u4").reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    place = np.where(codes >= 0xC0, codes.astype(np.int64) - 0xC0 + 26, codes.astype(np.int64) - 0x61)
    flat = np.bincount((place + ALPHABET * np.arange(len(codes))[:, None]).ravel(), minlength=ALPHABET * len(codes))
    kind = np.float32 if codes.shape[1] <= FLOAT32_LENGTH else np.float64
    return flat.reshape(len(codes), ALPHABET).astype(kind)


def one_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of equal length differ at one place, or the longer has one letter more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    short, long = (a, b) if a.shape[1] < b.shape[1] else (b, a)
    front = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= short.shape[1]


def near_pairs(a: list[str], b: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near words of two tiles, or of one (first place smaller)."""
    x = letters(a)
    y = x if b is None else letters(b)
    f, g = letter_counts(x), letter_counts(y)
    square = (g * g).sum(axis=1)
    found = [[], []]
    for lo in range(0, len(x), ROWS):
        rows = f[lo : lo + ROWS]
        distance = (rows * rows).sum(axis=1)[:, None] + square[None, :] - 2 * (rows @ g.T)
        i, j = np.nonzero(distance <= 2)
        i += lo
        if b is None:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), CHECKED):
            p, q = i[at : at + CHECKED], j[at : at + CHECKED]
            ok = one_apart(x[p], y[q])
            found[0].append(p[ok])
            found[1].append(q[ok])
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in found)


def strongest(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each i its near words j: their number and the one of largest n, the first of equals."""
    order = np.lexsort((j, -n[j], i))
    who, first, count = np.unique(i[order], return_index=True, return_counts=True)
    return who, count, j[order][first]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two word lists (the second NULL: within the first) to word, n_near, form_n, form."""
    for batch in batches:
        out = [[], [], [], []]
        for left, right in zip(*(batch.column(k) for k in range(2)), strict=True):
            sides = [s.values for s in (left, right) if s.is_valid]
            words = [s.field("word").to_pylist() for s in sides]
            counts = [s.field("n").to_numpy(zero_copy_only=False) for s in sides]
            i, j = near_pairs(*words)
            if not len(i):
                continue
            if len(words) == 1:
                views = [(np.concatenate((i, j)), np.concatenate((j, i)), 0, 0)]
            else:
                views = [(i, j, 0, 1), (j, i, 1, 0)]
            for p, q, own, other in views:
                who, n_near, best = strongest(p, q, counts[other])
                out[0] += [words[own][k] for k in who]
                out[1] += n_near.tolist()
                out[2] += counts[other][best].tolist()
                out[3] += [words[other][k] for k in best]
        if out[0]:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form_n, form: for each word that has any the number of its near words, and of
    these the one of largest n (the smallest of equals). `words` is a stored table word, n.
    """
    rows = words.count()
    classes = letter_classes(words, rows)
    cut = materialize(tiles(words, classes))
    left = cut.select("block", "tile", "words", F.explode(neighbours(F.col("block"), len(classes))).alias("other"))
    right = cut.select(F.col("block").alias("other"), F.col("tile").alias("_tile"), F.col("words").alias("_words"))
    own = (F.col("other") == F.col("block")) & (F.col("tile") == F.col("_tile"))
    pairs = left.join(right, "other").filter((F.col("other") != F.col("block")) | (F.col("tile") <= F.col("_tile")))
    found = pairs.select("words", F.when(~own, F.col("_words")).alias("_words")).mapInArrow(
        _near, "word string, n_near bigint, form_n bigint, form string"
    )
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    grouped = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return grouped.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


# ---- forms and roots -------------------------------------------------------------------


def last_forms(forms: DataFrame, most: int) -> DataFrame:
    """word, root: from each word of a stored table word, form along the forms to the last.

    A form is RATIO times as frequent as its word, so a path has at most log(most) steps; each
    round doubles the steps taken.
    """
    steps = max(1, math.floor(math.log(max(most, 1) / LEAST_COUNT + 1, RATIO)) + 1)
    state = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        state = materialize(state.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    return state


def spelling_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table word, n of distinct words.

    A word's form is its most frequent near word if that is at least RATIO times as frequent;
    without near words n_near is 0, without a form form and form_n are NULL and the root is the
    word itself. An empty table gives an empty result; other columns are ignored.
    """
    words = materialize(words.select("word", "n"))
    near = near_words(words)
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        *[F.when(F.col("form_n") >= RATIO * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")],
    )
    rows = materialize(rows)
    most = words.agg(F.max("n").alias("m")).first()["m"] or 0
    roots = last_forms(rows.filter(F.col("form").isNotNull()), most)
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
