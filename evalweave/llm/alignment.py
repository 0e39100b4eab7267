"""Alignment of two tokenizers over the same bytes.

A (byte-level) codes a blank and the text, B (pieces) the text, to which it adds that
blank itself. Both sides are flat Arrow lists with the row each token belongs to; byte
lengths, summed up within a row, are the offsets where tokens end. A full outer hash join
of the two tables of ends on (document, end) gives, in order, every stretch of bytes that
lies in one token of either side: its A and B tokens are linked, and where both end there
a group ends. Links are counted by document with Table.group_by in each task, and Spark
adds the counts up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from evalweave.llm.coders import binary, byte_alphabet, byte_bpe, coded_rows, id_type, pieces, row_runs
from evalweave.sources.scratch import materialize

BLANK = "▁"
HELD = 1 << 20  # pairs of ids whose counts each task holds (17 bytes each); rarer ones are joined
PARTIAL = 500_000  # rows of partial counts a task gathers before it sums them up
LINKS = 300_000  # links counted at once, unless one document has more

# ---- the two vocabularies -----------------------------------------------------


def byte_level_tokens(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; characters outside the alphabet stay as UTF-8."""
    to = byte_alphabet()
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return [bytes(to[c] for c in n) if all(c in to for c in n) else n.encode() for n in names]


def piece_tokens(model: SentencePieceProcessor) -> list[bytes]:
    """The bytes of each id of a piece vocabulary: the blank sign is a space, <0xHH> a byte."""
    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    return [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)]


def gives_back(flat: np.ndarray, border: np.ndarray, tokens: pa.Array, body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bytes of each row's ids are the row's own bytes."""
    size = pc.binary_length(tokens).to_numpy()
    total = np.concatenate(([0], np.cumsum(size[flat])))[border]
    exact = np.diff(total) == np.diff(at)
    if not len(flat) or not exact.any():
        return exact
    made = np.frombuffer(tokens.take(pa.array(flat)).buffers()[2], dtype=np.uint8)
    if not exact.all():
        made = made[: total[-1]][np.repeat(exact, np.diff(total))]
        body = body[np.repeat(exact, np.diff(at))]
        at = np.concatenate(([0], np.cumsum(np.diff(at) * exact)))
    wrong = np.flatnonzero(made[: len(body)] != body)
    exact[np.searchsorted(at, wrong, side="right") - 1] = False
    return exact


# ---- one run of rows ------------------------------------------------------------


def ends(lists: pa.ListArray, size: np.ndarray) -> pa.Table:
    """doc, end, place: of each token its row, the bytes of the row up to its end, and its place in the flat list."""
    flat, doc = lists.flatten(), pc.list_parent_indices(lists).cast(pa.int32())
    total = pc.cumulative_sum(pa.array(size).take(flat))
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    first = np.cumsum(n) - n
    before = np.concatenate(([0], total.to_numpy()))[first]
    end = pc.subtract(total, pa.array(before).take(doc))
    return pa.table({"doc": doc, "end": end, "place": pa.array(np.arange(len(flat), dtype=np.int32))})


def stretches(a: pa.ListArray, b: pa.ListArray, sizes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, A token, B token, whether both end) of each stretch of bytes inside one token of either."""
    left = ends(a, sizes[0]).rename_columns(["doc", "end", "a"])
    right = ends(b, sizes[1]).rename_columns(["doc", "end", "b"])
    both = left.join(right, keys=["doc", "end"], join_type="full outer", use_threads=False)
    both = both.sort_by([("doc", "ascending"), ("end", "ascending")])
    group_end = pc.and_(pc.is_valid(both["a"]), pc.is_valid(both["b"]))
    columns = both["doc"], pc.fill_null_backward(both["a"]), pc.fill_null_backward(both["b"]), group_end
    return tuple(c.to_numpy() for c in columns)


def labels(vocabulary: tuple[int, int]) -> pa.Array:
    """The text of each id with the sign behind it: A inside a group and at its end, then B likewise."""
    signs = ((vocabulary[0], ","), (vocabulary[0], "|"), (vocabulary[1], ","), (vocabulary[1], ";"))
    return pa.array([f"{i}{sign}" for n, sign in signs for i in range(n)], pa.large_string())


def group_texts(a, b, doc, at_a, at_b, group_end, names: pa.Array, vocabulary: tuple[int, int], rows: int) -> list[bytes]:
    """Per row its groups as text: `a1,a2|b1;a3|b2,b3`, put together from the labels of all tokens."""
    last_a, last_b = at_a[group_end], at_b[group_end]
    is_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
    is_last[0][last_a], is_last[1][last_b] = True, True
    group = tuple(np.concatenate(([0], np.cumsum(x)[:-1])) if len(x) else np.zeros(0, np.int64) for x in is_last)
    before_b = np.concatenate(([0], last_b + 1))  # B tokens before each group
    token = np.empty(len(a) + len(b), dtype=np.int64)
    n_a, n_b = vocabulary
    token[np.arange(len(a)) + before_b[group[0]]] = a + n_a * is_last[0]
    token[np.arange(len(b)) + np.append(last_a + 1, len(a))[group[1]]] = b + 2 * n_a + n_b * is_last[1]
    text = names.take(pa.array(token))
    _, offsets, data = text.buffers()
    place = np.frombuffer(offsets, dtype=np.int64, count=len(text) + 1) if len(text) else np.zeros(1, np.int64)
    tokens = np.bincount(doc[group_end], weights=np.diff(last_a, prepend=-1) + np.diff(last_b, prepend=-1), minlength=rows)
    border = np.concatenate(([0], np.cumsum(tokens.astype(np.int64))))
    body = memoryview(data) if data is not None else memoryview(b"")
    return [bytes(body[place[x] : max(place[x], place[y] - 1)]) for x, y in zip(border[:-1], border[1:], strict=True)]


def lists(border: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(values.astype(np.int32)))


# ---- the operator ---------------------------------------------------------------


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups (text), and links: the ids of A and B of each linked
    pair in order, as little-endian unsigned integers, of two bytes where both vocabularies allow it.

    NULL and empty texts, and texts that either tokenizer does not give back byte for byte, have
    no tokens: zeros and empty values. Repeated rows stay; an empty table gives an empty result;
    other columns are ignored. A text needs memory in proportion to its length.
    """
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    value = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("key"), F.when(value != "", F.concat(F.lit(" "), value)).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_model, b_model = Tokenizer.from_str(shared.value[0]), SentencePieceProcessor(model_proto=shared.value[1])
        tokens = tuple(pa.array(t, pa.large_binary()) for t in (byte_level_tokens(a_model), piece_tokens(b_model)))
        sizes = tuple(pc.binary_length(t).to_numpy() for t in tokens)
        vocabulary = tuple(len(t) for t in tokens)
        names = labels(vocabulary)
        encode_a, encode_b = byte_bpe(shared.value[0], special_as_text=True), pieces(b_model)
        for batch in batches:
            for lo, hi, body, at, sides in coded_rows(batch.column(1), encode_a, lambda texts: encode_b([t[1:] for t in texts])):
                exact = np.logical_and(*(gives_back(*side, t, body, at) for side, t in zip(sides, tokens, strict=True)))
                (a, border_a), (b, border_b) = (kept(*side, exact) for side in sides)
                doc, at_a, at_b, group_end = stretches(lists(border_a, a), lists(border_b, b), sizes)
                texts = group_texts(a, b, doc, at_a, at_b, group_end, names, vocabulary, hi - lo)
                n_links = np.bincount(doc, minlength=hi - lo)
                links = np.empty((len(doc), 2), dtype=id_type(max(vocabulary)))
                links[:, 0], links[:, 1] = a[at_a], b[at_b]
                cut = np.concatenate(([0], np.cumsum(n_links))) * 2 * links.itemsize
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(border_a)),
                        pa.array(np.diff(border_b)),
                        pa.array(np.bincount(doc[group_end], minlength=hi - lo).astype(np.int64)),
                        pa.array(n_links.astype(np.int64)),
                        pa.array([t.decode() for t in texts], pa.string()),
                        binary(cut, links),
                    ],
                    names=["key", "n_a", "n_b", "n_groups", "n_links", "groups", "links"],
                )

    schema = f"`{key}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links binary"
    return rows.mapInArrow(run, schema)


def kept(flat: np.ndarray, border: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The flat list without the items of the rows left out."""
    if rows.all():
        return flat, border
    n = np.diff(border)
    return flat[np.repeat(rows, n)], np.concatenate(([0], np.cumsum(n * rows)))


def linked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the last two columns, n_links and links: the row, A id and B id of every link."""
    n = batch.column(batch.num_columns - 2).to_numpy()
    body = b"".join([x.as_buffer() for x in batch.column(batch.num_columns - 1)])
    ids = np.frombuffer(body, dtype=f"<u{max(len(body) // max(2 * n.sum(), 1), 1)}").reshape(-1, 2)
    return np.repeat(np.arange(len(n), dtype=np.int32), n), ids[:, 0].astype(np.int32), ids[:, 1].astype(np.int32)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n: how many rows of `aligned` hold the pair linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def summed() -> pa.Table:
            out = pa.concat_tables(parts).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")])
            return out.rename_columns(["a", "b", "n"])

        for batch in batches:
            for rows in row_runs(batch, batch.column(0).to_numpy(), LINKS):
                links = pa.table(dict(zip(("doc", "a", "b"), linked(rows), strict=True)))
                once = links.group_by(["doc", "a", "b"], use_threads=False).aggregate([])
                part = once.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["a", "b", "n"])
                parts.append(part)
                size += part.num_rows
                if size > PARTIAL:
                    parts = [summed()]
                    size = parts[0].num_rows
                    if size > PARTIAL // 2:
                        yield from parts[0].to_batches()
                        parts, size = [], 0
        if parts:
            yield from summed().to_batches()

    partial = aligned.select("n_links", "links").mapInArrow(run, "a int, b int, n bigint")
    return partial.groupBy("a", "b").agg(F.sum("n").alias("n"))


def with_counts(aligned: DataFrame, held: int = HELD) -> DataFrame:
    """The rows of a stored `align` with n_best and count_sum, without links.

    n_best counts the links whose pair is the most frequent of its A id, count_sum adds up the
    counts of all links. Every task holds the counts of the most frequent pairs: those above
    1 / held of the sum of all counts, so never more than `held`. Links of other pairs are
    joined with the counts by pair; no such pair has more than that share of the rows.
    """
    spark = aligned.sparkSession
    counts = materialize(pair_counts(aligned))
    best = counts.groupBy("a").agg(F.max("n").alias("top"))
    known = materialize(counts.join(best, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best")))
    total = known.agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c")).first()
    all_fit = total["c"] <= held
    least = 0 if all_fit else total["s"] // held
    table = known.filter(F.col("n") > least).toArrow()  # at most `held` rows
    pairs = _packed(table["a"].to_numpy(), table["b"].to_numpy())
    order = np.argsort(pairs)
    shared = spark.sparkContext.broadcast((pairs[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order]))
    rows = aligned if all_fit else aligned.withColumn("_row", F.monotonically_increasing_id())
    rest = [c for c in rows.columns if c not in ("n_links", "links")]
    zero = F.lit(0).cast("bigint")
    sums = rows.select(*rest, "n_links", "links").mapInArrow(
        lambda batches: (_sums(r, shared.value) for b in batches for r in row_runs(b, b.column(b.num_columns - 2).to_numpy(), LINKS)),
        rows.select(*rest, "n_links", zero.alias("n_best"), zero.alias("count_sum")).schema,
    )
    if all_fit:
        return sums
    rare = _rare_sums(rows, known.filter(F.col("n") <= least), shared)
    return sums.join(rare, "_row", "left").select(
        *[c for c in rest if c != "_row"], "n_links",
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
    )


def _packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def _found(batch: pa.RecordBatch, pairs: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The row of each link, the links as a dictionary of pairs, where those stand in `pairs`, and whether they do."""
    row, a, b = linked(batch)
    links = pa.array(_packed(a, b)).dictionary_encode()
    own = links.dictionary.to_numpy()
    place = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
    return row, links, place, pairs[place] == own if len(pairs) else np.zeros(len(own), bool)


def _sums(batch: pa.RecordBatch, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    pairs, count, best = known
    _, links, place, here = _found(batch, pairs)
    kind, k = links.indices.to_numpy(), batch.num_columns - 2
    if len(pairs):
        n, top = np.where(here, count[place], 0)[kind], (here & best[place])[kind]
    else:
        n, top = np.zeros((2, len(kind)), dtype=np.int64)
    border = np.concatenate(([0], np.cumsum(batch.column(k).to_numpy())))
    by_row = [np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[border]) for x in (top, n)]
    return pa.RecordBatch.from_arrays(
        [*batch.columns[: k + 1], *map(pa.array, by_row)], names=[*batch.schema.names[: k + 1], "n_best", "count_sum"]
    )


def _rare_sums(rows: DataFrame, counts: DataFrame, shared) -> DataFrame:
    """_row, _best, _sum over the links whose pair no task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_runs(batch, batch.column(1).to_numpy(), LINKS):
                row, links, _, here = _found(part, shared.value[0])
                kind = links.indices.to_numpy()
                at = np.flatnonzero(~here[kind])
                table = pa.table({"_row": part.column(0).take(pa.array(row[at])), "pair": links.dictionary.take(pa.array(kind[at]))})
                table = table.group_by(["_row", "pair"], use_threads=False).aggregate([([], "count_all")])
                pair = table["pair"].to_numpy()
                a, b = (pa.array(x.astype(np.int32)) for x in (pair >> 32, pair & 0xFFFFFFFF))
                yield from pa.table({"_row": table["_row"], "a": a, "b": b, "m": table["count_all"]}).to_batches()

    links = rows.select("_row", "n_links", "links").mapInArrow(run, "_row bigint, a int, b int, m bigint")
    best = F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("_best")
    return links.join(counts, ["a", "b"]).groupBy("_row").agg(best, F.sum(F.col("m") * F.col("n")).alias("_sum"))
