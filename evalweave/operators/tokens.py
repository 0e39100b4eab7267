"""Token rows: build, pack, clip, pad and batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions import arrays as A
from evalweave.functions import text as T
from evalweave.functions.hashing import hash_uniform
from evalweave.functions.ordering import prefix_totals, ranked
from evalweave.operators.project import render_header
from evalweave.sources.scratch import materialize

# The sentinel of a label that takes no part in the loss, and the
# ids below the first word of a vocabulary.
IGNORE = -100
PAD, EOS, MASK, UNK = 0, 1, 2, 3
FIRST_WORD = 4
HELD = 1 << 17  # words of a vocabulary that each task holds, none above LONGEST letters
LONGEST = 64
ROW_ARRAYS = ("input_ids", "labels", "attention_mask")

# ---- vocabulary --------------------------------------------------------------


def build_vocab(words: DataFrame, words_col: str) -> DataFrame:
    """Table word, id: ids count up by falling word count, then by word.

    The counts are written once and sorted in ranges of both keys, so neither the many
    words seen once nor words with a common beginning meet in one task.
    """
    counts = materialize(
        words.select(F.explode(words_col).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )
    placed = ranked(counts, [F.desc("n"), F.asc("word")], "_pos")
    return placed.select("word", (F.col("_pos") + FIRST_WORD).cast("int").alias("id"))


def encode_words(df: DataFrame, key: str, words_col: str, vocab: DataFrame, out: str = "input_ids") -> DataFrame:
    """Word arrays to id arrays (unknown words get UNK), as a table `key`, `out`; the key is unique.

    Every task looks up the HELD words of lowest id, the most frequent ones of `build_vocab`, in
    whole Arrow batches. Only where the vocabulary has more do the words not found there become
    rows: they are joined with the vocabulary and put back into their places. Rows without words,
    or with NULL words, keep an empty array.
    """
    vocab = materialize(vocab)  # read by every step below
    held = vocab.filter(F.length("word") <= LONGEST).orderBy("id").limit(HELD).toArrow()
    shared = df.sparkSession.sparkContext.broadcast((held["word"].combine_chunks(), held["id"].combine_chunks()))
    whole = vocab.count() <= held.num_rows

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = shared.value
        for batch in batches:
            words = batch.column(1)
            flat, n = words.flatten(), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            found = ids.take(pc.index_in(flat, value_set=known))
            missing = found.is_null().to_numpy(zero_copy_only=False)
            border = np.concatenate(([0], np.cumsum(n)))
            if whole:
                found, absent = found.fill_null(UNK), np.zeros(len(n) + 1)
            else:  # the k-th of a row that is not held, as -k
                count = np.concatenate(([0], np.cumsum(missing)))
                place = count[1:] - np.repeat(count[border[:-1]], n)
                found, absent = pc.if_else(pa.array(missing), pa.array(-place, pa.int32()), found), count[border]
            rest = pa.ListArray.from_arrays(pa.array(absent, pa.int32()), flat.filter(pa.array(missing & (not whole))))
            column = pa.ListArray.from_arrays(pa.array(border, pa.int32()), found.cast(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), column, rest], names=["_key", "_ids", "_rest"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, words_col).mapInArrow(look_up, f"_key {kind}, _ids array<int>, _rest array<string>")
    if whole:
        return rows.select(F.col("_key").alias(key), F.col("_ids").alias(out))
    rows = materialize(rows)
    long = rows.select("_key", F.posexplode("_rest").alias("_pos", "_word"))
    names = vocab.select(F.col("word").alias("_word"), F.col("id").alias("_id"))
    rare = long.join(names, "_word", "left").groupBy("_key").agg(
        F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("_id", F.lit(UNK)).alias("id"))))["id"].alias("_rare")
    )
    put = F.transform("_ids", lambda x: F.when(x < 0, F.get("_rare", -x - 1)).otherwise(x))
    return rows.join(rare, "_key", "left").select(F.col("_key").alias(key), put.alias(out))


def chat_tokens(chats: DataFrame, key: str, vocab: DataFrame, mask_prompt_loss: bool = True) -> DataFrame:
    """input_ids and labels of a chat; the prompt part is ignored in the labels."""
    m = F.col("messages")
    prompt = F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))
    rows = chats.select(
        key,
        T.words(render_header(m)).alias("_words"),
        F.size(T.words(render_header(prompt, True))).alias("prompt_len"),
    )
    ids = F.col("input_ids")
    out = encode_words(rows, key, "_words", vocab)
    if not mask_prompt_loss:
        return out.withColumn("labels", ids)
    n = F.least(F.col("prompt_len"), F.size(ids))
    masked = F.concat(A.fill(IGNORE, n), A.tail_from(ids, n))
    return out.join(rows.select(key, "prompt_len"), key).withColumn("labels", masked)


# ---- packing -----------------------------------------------------------------


def append_eos(ids: Column, eos: int = EOS) -> Column:
    last = F.try_element_at(ids, F.lit(-1))
    return F.when(last.eqNullSafe(F.lit(eos)), ids).otherwise(F.concat(ids, F.array(F.lit(eos).cast("int"))))


def pack_sequences(
    df: DataFrame,
    key: str,
    seq_length: int,
    batch_rows: int | None = 1000,
    insert_eos: bool = False,
    drop_tail: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Concatenate token rows in key order and cut them into equal chunks.

    `batch_rows` rows are concatenated at a time, and each such batch drops (or
    keeps) its own tail; None concatenates the whole table. Rows travel as
    slices, one per chunk they touch, so no token is a row of its own and a chunk
    collects at most `seq_length` slices.
    """
    ids = append_eos(F.col("input_ids")) if insert_eos else F.col("input_ids")
    rows = df.select(*by, key, ids.alias("ids")).withColumn("_len", F.size("ids").cast("bigint"))
    if batch_rows is None:
        placed = prefix_totals(rows, key, "_start", F.col("_len"), by).withColumn("pack_group", F.lit(0).cast("bigint"))
    else:
        numbered = prefix_totals(rows, key, "_pos", by=by).withColumn("pack_group", F.expr(f"_pos div {int(batch_rows)}"))
        inside = Window.partitionBy(*by, "pack_group").orderBy(key)
        placed = numbered.withColumn("_start", F.sum("_len").over(inside) - F.col("_len"))
    first, last = F.expr(f"_start div {seq_length}"), F.expr(f"(_start + _len - 1) div {seq_length}")
    pieces = (
        placed.filter(F.col("_len") > 0)
        .withColumn("chunk", F.explode(F.sequence(first, last)))
        .withColumn("_from", F.greatest(F.col("chunk") * seq_length - F.col("_start"), F.lit(0)))
        .withColumn("_to", F.least((F.col("chunk") + 1) * seq_length - F.col("_start"), F.col("_len")))
        .select(
            *by,
            "pack_group",
            "chunk",
            F.struct(
                (F.col("_start") + F.col("_from")).alias("at"),
                F.slice("ids", (F.col("_from") + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int")).alias("ids"),
            ).alias("piece"),
        )
    )
    chunks = pieces.groupBy(*by, "pack_group", "chunk").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["ids"])).alias("input_ids")
    )
    if drop_tail:
        chunks = chunks.filter(F.size("input_ids") == seq_length)
    return chunks.withColumn("labels", F.col("input_ids"))


# ---- clipping ----------------------------------------------------------------


def _each(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """Apply the same change to every array column of a token row."""
    return df.withColumns({c: change(F.col(c)) for c in ROW_ARRAYS if c in df.columns})


def clip(df: DataFrame, max_length: int, truncation: str = "right") -> DataFrame:
    """`right` keeps the first, `left` the last max_length items."""
    if truncation == "right":
        return _each(df, lambda a: A.head(a, max_length))
    if truncation == "left":
        return _each(df, lambda a: A.last_n(a, max_length))
    raise NotImplementedError(truncation)


def clip_keep_prompt(df: DataFrame, max_length: int, truncation: str = "right", whole_at_zero: bool = True) -> DataFrame:
    """Keep the prompt and clip the response to what is left of the length.

    `whole_at_zero`: clipping from the left with nothing left keeps the whole
    response, as a slice from -0 does; False drops it.
    """
    if truncation not in ("right", "left"):
        raise NotImplementedError(truncation)
    plain = clip(df, max_length, truncation)
    if "prompt_len" not in df.columns:
        return plain
    n = F.col("prompt_len")

    def change(a: Column) -> Column:
        prompt, response = A.head(a, n), A.tail_from(a, F.least(n, F.size(a)))
        budget = F.greatest(max_length - F.size(prompt), F.lit(0))
        if truncation == "right":
            kept = A.head(response, budget)
        else:
            kept = A.last_n(response, budget)
            if whole_at_zero:
                kept = F.when(budget == 0, response).otherwise(kept)
        clipped = A.head(a, max_length) if truncation == "right" else A.last_n(a, max_length)
        return F.when(n >= 0, F.concat(prompt, kept)).otherwise(clipped)

    return _each(df, change)


def post_process(df: DataFrame, max_length: int, truncation: str) -> DataFrame:
    """Filter long rows, or drop long prompts and clip; batch and stream alike."""
    from evalweave.operators.select import max_tokens, prompt_fits

    if truncation == "filter":
        return max_tokens(df, max_length)
    if truncation == "right":
        return clip(prompt_fits(df, max_length), max_length)
    raise NotImplementedError(truncation)


# ---- batches -----------------------------------------------------------------


def make_batches(df: DataFrame, key: str, size: int, out: str = "batch") -> DataFrame:
    """Number of the batch of `size` consecutive rows each row is in."""
    return prefix_totals(df, key, "_pos").withColumn(out, F.expr(f"_pos div {int(size)}")).drop("_pos")


def pad_batch(df: DataFrame, batch: str = "batch", pad: int = PAD, ids: str = "input_ids") -> DataFrame:
    """Pad ids on the right to the longest of the batch, with a 0/1 mask."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return (
        df.withColumn("_gap", longest - F.size(ids))
        .withColumn("attention_mask", F.concat(A.fill(1, F.size(ids)), A.fill(0, F.col("_gap"))))
        .withColumn(ids, F.concat(F.col(ids), A.fill(F.lit(pad).cast("int"), F.col("_gap"))))
        .drop("_gap")
    )


def prepend_bos(df: DataFrame, bos: int, batch: str | None = None) -> DataFrame:
    """Put BOS in front (ignored in labels, 1 in the mask).

    With `batch`, a batch in which every row's labels start ignored stays as is.
    """
    front = {"input_ids": bos, "labels": IGNORE, "attention_mask": 1}
    cols = [c for c in ROW_ARRAYS if c in df.columns]
    rows = df
    if batch is not None and "labels" in cols:
        starts_ignored = F.coalesce(F.get("labels", 0) == IGNORE, F.lit(False))
        rows = rows.withColumn("_skip", F.bool_and(starts_ignored).over(Window.partitionBy(batch)))
    else:
        rows = rows.withColumn("_skip", F.lit(False))
    changes = {
        c: F.when(F.col("_skip"), F.col(c)).otherwise(F.concat(F.array(F.lit(front[c]).cast("int")), F.col(c))) for c in cols
    }
    return rows.withColumns(changes).drop("_skip")


def drop_attention_mask(df: DataFrame) -> DataFrame:
    return df.drop("attention_mask")


def random_truncate(df: DataFrame, batch: str, ratio: float = 0.01, seed: int = 42) -> DataFrame:
    """In a share of batches, ignore all items from a random length on.

    Shapes stay: the mask becomes 0 and labels are ignored. A missing mask is
    made in the batches that are cut, and is 1 elsewhere.
    """
    length = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    chosen = hash_uniform(seed, "truncate", F.col(batch)) < ratio
    cut = F.floor(hash_uniform(seed, "length", F.col(batch)) * F.col("_longest")) + 1
    rows = df if "attention_mask" in df.columns else df.withColumn("attention_mask", A.fill(1, F.size("input_ids")))

    def beyond(a: str, value: int) -> Column:
        return A.let(F.col("_cut"), lambda cut_at: F.transform(a, lambda x, i: F.when(i >= cut_at, value).otherwise(x)))

    changes = {"attention_mask": beyond("attention_mask", 0)}
    if "labels" in df.columns:
        changes["labels"] = beyond("labels", IGNORE)
    return (
        rows.withColumn("_longest", length)
        .withColumn("_cut", F.when(chosen, cut).otherwise(F.col("_longest")))
        .withColumns(changes)
        .drop("_longest", "_cut")
    )


def append_eos_block(df: DataFrame, block_size: int, eos: int = EOS) -> DataFrame:
    """Fill ids and labels with EOS up to a multiple of the block size."""
    gap = F.pmod(-F.size("input_ids"), F.lit(block_size))
    end = A.fill(F.lit(eos).cast("int"), gap)
    return df.withColumns({"input_ids": F.concat("input_ids", end), "labels": F.concat("labels", end)})


def _response_len() -> Column:
    return F.size("input_ids") - F.col("prompt_len")


def perbatch_cutoff(df: DataFrame, batch: str, key: str, seed: int = 42) -> DataFrame:
    """Trim every response to the length of one response picked per batch."""
    w = Window.partitionBy(batch)
    pick = F.struct(hash_uniform(seed, "keep", F.col(batch), F.col(key)), F.col(key))
    extra = F.greatest(_response_len() - F.min_by(_response_len(), pick).over(w), F.lit(0))
    return _each(df.withColumn("_extra", extra), lambda a: A.head(a, F.size(a) - F.col("_extra"))).drop("_extra")


def resp_cutoff(df: DataFrame, batch: str, ratio: float, seed: int = 42) -> DataFrame:
    """In a share of batches, cut all rows to the longest length less a random
    number below the shortest response.
    """
    w = Window.partitionBy(batch)
    u = hash_uniform(seed, "cut", F.col(batch))
    cut = F.floor(u * (F.col("_min") - 1)) + 1
    apply = (hash_uniform(seed, "apply", F.col(batch)) < ratio) & (F.col("_min") > 1)
    return (
        _each(
            df.withColumn("_min", F.min(_response_len()).over(w))
            .withColumn("_max", F.max(F.size("input_ids")).over(w))
            .withColumn("_keep", F.when(apply, F.col("_max") - cut).otherwise(F.col("_max"))),
            lambda a: A.head(a, F.col("_keep")),
        ).drop("_min", "_max", "_keep")
    )


def cut_batches(df: DataFrame, batch: str, key: str, perbatch: bool = False, ratio: float = 0.0, seed: int = 42) -> DataFrame:
    """The cutoff that a collator's settings choose: with `perbatch` that one alone, whatever
    the ratio; else the response cutoff in that share of batches; with neither, the rows
    as they are. A ratio outside [0, 1] is an error.
    """
    if not 0 <= ratio <= 1:
        raise ValueError(f"ratio {ratio} is not in [0, 1]")
    if perbatch:
        return perbatch_cutoff(df, batch, key, seed)
    return resp_cutoff(df, batch, ratio, seed) if ratio else df


def edit_source_pair(df: DataFrame, bos: int, masks: int = 0, mask_id: int = MASK) -> DataFrame:
    """Target x1 and source x0: the prompt (or BOS) followed by `masks` mask tokens."""
    ids = F.col("input_ids")
    tail = A.fill(F.lit(mask_id).cast("int"), F.lit(masks))
    if "prompt_len" in df.columns:
        return df.withColumn("x1_ids", ids).withColumn("x0_ids", F.concat(A.head(ids, F.col("prompt_len")), tail))
    first = F.array(F.lit(bos).cast("int"))
    has_bos = F.coalesce(F.get(ids, 0) == bos, F.lit(False))
    x1 = F.when(has_bos, ids).otherwise(F.concat(first, ids))
    return df.withColumn("x1_ids", x1).withColumn("x0_ids", F.concat(first, tail))


# ---- pairs -------------------------------------------------------------------

Encoder = Callable[[Column], Column]


def _move_trailing_space(df: DataFrame, context: str, continuation: str) -> DataFrame:
    """Give the context's trailing white space to the continuation."""
    bare = T.rstrip(context)
    return df.withColumn("_bare", bare).withColumn(
        "_whole", F.concat(F.col("_bare"), F.substr(context, F.length("_bare") + 1), F.col(continuation))
    )


def encode_pair(df: DataFrame, context: str, continuation: str, encode: Encoder, max_length: int) -> DataFrame:
    """context_ids and continuation_ids; the latter are the whole's ids behind the
    context's. Pairs longer than max_length are rejected.
    """
    rows = (
        _move_trailing_space(df, context, continuation)
        .withColumn("context_ids", encode(F.col("_bare")))
        .withColumn("_all", encode(F.col("_whole")))
        .withColumn("continuation_ids", A.tail_from(F.col("_all"), F.least(F.size("context_ids"), F.size("_all"))))
    )
    fits = F.size("context_ids") + F.size("continuation_ids") <= max_length
    return rows.filter(fits).drop("_bare", "_whole", "_all")


def encode_pair_cutoff(
    df: DataFrame, context: str, continuation: str, encode: Encoder, max_length: int, bos: str = "", eos: int = EOS
) -> DataFrame:
    """The same with BOS text and EOS id, cut on the left to max_length."""
    c, w = F.col("context_ids"), F.col("_all")
    over = F.greatest(F.size(w) - max_length, F.lit(0))
    remain = F.size(c) - over
    return (
        _move_trailing_space(df.withColumn("_context", F.concat(F.lit(bos), F.col(context))), "_context", continuation)
        .withColumn("context_ids", encode(F.col("_bare")))
        .withColumn("_all", F.concat(encode(F.col("_whole")), F.array(F.lit(eos).cast("int"))))
        .withColumn(
            "continuation_ids",
            F.when((over > 0) & (remain <= 0), A.last_n(w, max_length)).otherwise(
                A.tail_from(w, F.least(F.size(c), F.size(w)))
            ),
        )
        .withColumn("context_ids", F.when(over > 0, A.last_n(c, remain)).otherwise(c))
        .drop("_context", "_bare", "_whole", "_all")
    )
