"""Benchmark decontamination by latent semantic retrieval.

Words are lower-cased runs of letters and digits (bytes above 7F count as letters). The vocabulary is that of the benchmark
(the stated query set); corpus words outside it only count as places. An item's answer
words are its rarest words in the benchmark, so many that a copy which covers enough of
the item always holds a fixed number of them, whichever words it leaves out.

1. One pass over the documents cuts out passages: where that many answer words of an item
   stand close enough to lie in one copy of it, the words around. It also counts in how
   many documents each word of the vocabulary occurs.
2. Distributed randomised SVD of the TF-IDF matrix of all passages (with the items as
   further rows): each task multiplies its rows with the current basis and adds up its
   part of the product; parts are summed by term. The driver only holds matrices of
   vocabulary x rank.
3. Passages and items are compared by cosine in the latent space. A passage and the item
   it was cut for, and pairs over a threshold, are candidates; a candidate stands if its
   longest common subsequence covers enough of the item. That also finds paraphrases that
   insert, drop or swap words. Neither the cut nor the cosine loses such a pair.

Items are taken in blocks of bounded size against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.frugal import frugal, small_batches
from evalweave.llm.words import LETTERS_DIGITS, chunks, word_hashes
from evalweave.sources.scratch import materialize

RANK = 96
ROUNDS = 2  # products with the matrix before the basis is used
COSINE = 0.45  # in the latent space, for a candidate
COVER = 0.7  # of an item's words in the longest common subsequence
ANSWERS = 5  # of so many words of an item, one answer word is in every copy
LEAST_WORDS = 5  # shorter items must occur whole
STRETCH = 1.5  # length of a paraphrase, in lengths of the item, at most
ITEMS = 4096  # items of a block


def least_cover(n: int) -> int:
    """Words of an item of n that a match must hold in order."""
    return n if n < LEAST_WORDS else int(np.ceil(n * COVER))


@dataclass
class Items:
    """A block of items: ids, word lists as vocabulary indices, their answer words, and how
    many of those any passage holds that covers the item.
    """

    ids: np.ndarray
    vocabulary: np.ndarray  # sorted word hashes
    words: list[np.ndarray]
    answers: list[np.ndarray]
    need: np.ndarray

    @staticmethod
    def read(ids: np.ndarray, texts: list[str]) -> Items:
        hashes = []
        for _, _, body, at in chunks(pa.array(texts, pa.string())):
            words, row = word_hashes(body, at, LETTERS_DIGITS, latin=True)
            hashes += [words[a:b] for a, b in zip(row[:-1], row[1:], strict=True)]
        some = [k for k, h in enumerate(hashes) if len(h)]
        ids, hashes = np.asarray(ids)[some], [hashes[k] for k in some]
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        words = [np.searchsorted(vocabulary, h) for h in hashes]
        spread = np.bincount(np.concatenate([np.zeros(0, np.int64), *(np.unique(w) for w in words)]), minlength=len(vocabulary))
        answers, need = [], []
        for w in words:
            own, times = np.unique(w, return_counts=True)
            order = np.lexsort((own, spread[own]))  # ties by hash: spread over the item
            missing = len(w) - least_cover(len(w))  # words that a match may lack
            n = int(np.searchsorted(np.cumsum(times[order]), min(missing + max(1, round(len(w) / ANSWERS)), len(w)))) + 1
            answers.append(own[order[:n]])
            need.append(n - int(np.searchsorted(np.cumsum(np.sort(times[order[:n]])), missing, side="right")))
        return Items(ids, vocabulary, words, answers, np.array(need, dtype=np.int64))

    def cover(self) -> np.ndarray:
        return np.array([least_cover(len(w)) for w in self.words])


def _ids(words: np.ndarray, vocabulary: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Vocabulary index of each word, -1 outside. `first` says which leading 16 bits occur."""
    out = np.full(len(words), -1, dtype=np.int32)
    maybe = np.flatnonzero(first[(words >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, words[maybe]), len(vocabulary) - 1)
    hit = vocabulary[at] == words[maybe]
    out[maybe[hit]] = at[hit]
    return out


def _passages(items: Items):
    """(doc_id, start, item, words): passages and the place of the item they are cut for.
    Rows with doc_id NULL: start is a term and `count` the number of documents of the task
    that hold it; start -1 counts all documents.
    """
    m = len(items.vocabulary)
    first = np.zeros(1 << 16, dtype=bool)
    first[(items.vocabulary >> np.uint64(48)).astype(np.int64)] = True
    size = np.array([len(a) for a in items.answers])
    term, owner = np.concatenate(items.answers), np.repeat(np.arange(len(size)), size)
    order = np.argsort(term, kind="stable")
    term, owner = term[order], owner[order]
    answer_at = np.searchsorted(term, np.arange(m + 1))
    is_answer = np.diff(answer_at) > 0
    need = items.need
    reach = np.array([int(np.ceil(len(w) * STRETCH)) for w in items.words])

    def cut(ids: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, first word, last word + 1, item) of the passages: for every run of `reach` words
        that holds enough answer words, one that holds the run. Cuts of nearby places are joined.
        """
        places = np.flatnonzero((ids >= 0) & is_answer[ids])
        if not len(places):
            return
        n = (answer_at[ids[places] + 1] - answer_at[ids[places]]).astype(np.int64)
        place = np.repeat(places, n)
        inner = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        item = owner[np.repeat(answer_at[ids[places]], n) + inner]
        by = np.lexsort((place, item))
        place, item = place[by], item[by]
        of = np.searchsorted(row, place, side="right") - 1
        last = np.arange(len(place)) + need[item] - 1
        fits = last < len(place)
        k, last = np.flatnonzero(fits), last[fits]
        near = (item[last] == item[k]) & (of[last] == of[k]) & (place[last] - place[k] < reach[item[k]])
        k, last = k[near], last[near]
        lo = np.maximum(row[of[k]], place[last] - reach[item[k]])
        hi = np.minimum(row[of[k] + 1], place[k] + reach[item[k]] + 1)
        if not len(k):
            return
        step = (place[k] - row[of[k]]) // np.maximum(1, reach[item[k]] // 4)
        begin = np.flatnonzero(np.concatenate(([True], (np.diff(item[k]) != 0) | (np.diff(of[k]) != 0) | (np.diff(step) != 0))))
        yield from zip(of[k][begin].tolist(), np.minimum.reduceat(lo, begin).tolist(), np.maximum.reduceat(hi, begin).tolist(), item[k][begin].tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs = np.zeros(m, dtype=np.int64), 0
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "start", "count", "item", "words"]
        for batch in batches:
            for lo, _, body, at in chunks(batch.column(1)):
                words, row = word_hashes(body, at, LETTERS_DIGITS, latin=True)
                ids = _ids(words, items.vocabulary, first)
                inside = np.flatnonzero(ids >= 0)
                doc = np.searchsorted(row, inside, side="right") - 1
                held += np.bincount(np.unique(doc * m + ids[inside]) % m, minlength=m)
                docs += len(row) - 1
                found = list(cut(ids, row))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([lo + f[0] for f in found], pa.int64())),
                            pa.array([f[1] - row[f[0]] for f in found], kinds[1]), pa.nulls(len(found), kinds[2]),
                            pa.array([f[3] for f in found], kinds[3]), pa.array([ids[f[1] : f[2]] for f in found], kinds[4]),
                        ],
                        names=names,
                    )
        count = np.append(held, docs)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(some), kinds[0]), pa.array(np.where(some == m, -1, some), kinds[1]), pa.array(count[some], kinds[2]), pa.nulls(len(some), kinds[3]), pa.nulls(len(some), kinds[4])],
            names=names,
        )

    return run


def _matrix(lists: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF rows of unit length as (row, term, value)."""
    row = np.repeat(np.arange(len(lists)), [len(w) for w in lists])
    flat = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
    row, flat = row[flat >= 0], flat[flat >= 0]
    key, times = np.unique(row * len(idf) + flat, return_counts=True)
    row, term = key // len(idf), key % len(idf)
    value = (1 + np.log(times)) * idf[term]
    length = np.sqrt(np.bincount(row, weights=value**2, minlength=len(lists)))
    return row, term, value / np.maximum(length[row], 1e-12)


def _times(row: np.ndarray, term: np.ndarray, value: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Rows of the matrix times the basis."""
    out = np.zeros((n, basis.shape[1]))
    if len(row):
        begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[begin]] = np.add.reduceat(value[:, None] * basis[term], begin, axis=0)
    return out


def _back(row: np.ndarray, term: np.ndarray, value: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """Transposed matrix times y."""
    out = np.zeros((m, y.shape[1]))
    if len(row):
        by = np.argsort(term, kind="stable")
        row, term, value = row[by], term[by], value[by]
        begin = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        out[term[begin]] = np.add.reduceat(value[:, None] * y[row], begin, axis=0)
    return out


def _lists(column: pa.Array, step: int = 2000) -> Iterator[tuple[int, list[np.ndarray]]]:
    for lo in range(0, len(column), step):
        part = column.slice(lo, step)
        at, flat = part.offsets.to_numpy(), part.values.to_numpy()
        yield lo, [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _product(idf: np.ndarray, basis: np.ndarray):
    """Each task's part of A^T A times the basis, as rows (term, row of the product)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(basis)
        for batch in batches:
            for _, lists in _lists(batch.column(0)):
                a = _matrix(lists, idf)
                total += _back(*a, _times(*a, basis, len(lists)), len(idf))
        some = np.flatnonzero(np.abs(total).sum(axis=1))
        rows = pa.FixedSizeListArray.from_arrays(pa.array(total[some].reshape(-1)), basis.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), rows], names=["term", "y"])

    return run


def fit_basis(passages: DataFrame, items: Items, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors of the passages' TF-IDF matrix (vocabulary x rank)."""
    m = len(idf)
    rank = min(rank, m)
    own = _matrix(items.words, idf)
    basis = np.random.default_rng(seed).standard_normal((m, rank))
    for _ in range(ROUNDS):
        parts = passages.select("words").mapInArrow(frugal(_product(idf, basis)), "term bigint, y array<double>")
        sums = parts.groupBy("term").agg(*(F.sum(F.col("y")[k]).alias(f"y{k}") for k in range(rank))).toPandas()  # a row a term at most
        product = _back(*own, _times(*own, basis, len(items.words)), m)
        product[sums["term"].to_numpy(np.int64)] += sums.drop(columns="term").to_numpy(float).reshape(len(sums), rank)
        basis, _ = np.linalg.qr(product)
    return basis


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & places.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _matches(items: Items, idf: np.ndarray, basis: np.ndarray, cosine: float):
    latent = _unit(_times(*_matrix(items.words, idf), basis, len(items.words)))
    need, cover = items.need, items.cover()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            own = batch.column(2).to_numpy()
            for lo, lists in _lists(batch.column(3)):
                found = _unit(_times(*_matrix(lists, idf), basis, len(lists))) @ latent.T
                wanted = found >= cosine
                wanted[np.arange(len(lists)), own[lo : lo + len(lists)]] = True  # cut for this item, whatever the cosine
                for p, i in zip(*np.nonzero(wanted), strict=True):
                    passage = lists[p]
                    if np.isin(items.answers[i], passage).sum() >= need[i]:
                        common = lcs(items.words[i], passage)
                        if common >= cover[i]:
                            out.append((doc[lo + p], int(items.ids[i]), start[lo + p], common, len(items.words[i]), float(found[p, i])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["doc_id", "item_id", "start", "common", "words", "cosine"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, start, common, words, cosine of every document that holds an item.

    `start` is the first word of the passage with the longest common subsequence, `common`
    its length and `words` the item's. NULL or empty texts and items match nothing; items
    with one text match each; repeated documents give one row an item; rows without doc_id
    give none; empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    asked = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, -(-asked.count() // ITEMS))
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint, start bigint, common bigint, words bigint, cosine double")
    for block in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").toPandas()
        items = Items.read(some["item_id"].to_numpy(), some["text"].tolist())
        if not len(items.ids):
            continue
        seen = materialize(texts.mapInArrow(frugal(_passages(items)), "doc_id bigint, start bigint, count bigint, item bigint, words array<int>"))
        counts = dict(seen.filter("doc_id IS NULL").groupBy("start").agg(F.sum("count")).collect())  # a row a term
        held = np.array([counts.get(t, 0) for t in range(len(items.vocabulary))])
        idf = np.log((1 + counts.get(-1, 0)) / (1 + held)) + 0.1
        passages = seen.filter("doc_id IS NOT NULL").select("doc_id", "start", "item", "words")
        basis = fit_basis(passages, items, idf)
        out = out.union(passages.mapInArrow(frugal(_matches(items, idf, basis, cosine)), out.schema))
    best = F.max(F.struct("common", -F.col("start"), "words", "cosine")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.col2")).alias("start"), F.col("b.common").alias("common"), F.col("b.words").alias("words"), F.col("b.cosine").alias("cosine")
    )
