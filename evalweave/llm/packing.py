"""Packing by concatenation: all documents in a row, cut into windows of one length.

Two passes of prefix sums. The first encodes every text and writes its ids with the
number of ids before it in its own partition; the totals of the partitions, summed up,
are the partitions' offsets in the whole. The second reads the table again and cuts each
document at the window borders it crosses. No ids are shuffled, and nothing but one row
a partition is ever ordered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalweave.llm.coders import binary, byte_bpe, coded_rows, id_type, row_runs
from evalweave.sources.scratch import materialize

LENGTH = 1024
END = 0  # closes every document
BLOCK = 1024  # partitions whose totals are summed up in one group
FEW = 1 << 20  # rows of the table of offsets (24 bytes each) up to which it is broadcast
OUT_IDS = 1_000_000  # ids in one record batch, unless a single document has more


def token_runs(docs: DataFrame, model: str, kind: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (of the given type, closed by END), and where they stand: their number, the task's
    number and the ids before them in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = byte_bpe(shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, _, _, ((ids, border),) in coded_rows(batch.column(1), encode):
                place = border + np.arange(hi - lo + 1)  # with one END a document
                whole = np.full(place[-1], END, dtype=kind)
                whole[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), np.diff(border))] = ids
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        binary(place * whole.itemsize, whole),
                        pa.array(np.diff(place)),
                        pa.array(np.full(hi - lo, part, dtype=np.int32)),
                        pa.array(before + place[:-1]),
                    ],
                    names=["key", "ids", "n", "part", "before"],
                )
                before += int(place[-1])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids binary, n bigint, part int, before bigint")


def partition_offsets(runs: DataFrame) -> DataFrame:
    """part, offset: the ids of all partitions before it, by sums inside blocks of BLOCK and over blocks."""
    ends = runs.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n"))
    ends = ends.withColumn("block", F.expr(f"part div {BLOCK}"))
    earlier = (Window.unboundedPreceding, -1)
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("part").rowsBetween(*earlier))
    blocks = ends.groupBy("block").agg(F.sum("n").alias("n"))
    over = F.sum("n").over(Window.orderBy("block").rowsBetween(*earlier))
    starts = blocks.select("block", F.coalesce(over, F.lit(0)).alias("start"))
    rows = ends.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, "block")
    return materialize(rows.select("part", (F.col("start") + F.col("inside")).alias("offset")))


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences of `length` ids; only the last sequence may be shorter.

    key, start and length of the piece in its document, doc_tokens, sequence_id, offset in the
    sequence, ids (little-endian unsigned 32-bit). Documents stand in the order of the partitions
    that read them. NULL and empty texts are the END id alone; repeated rows are packed each; an
    empty table has no pieces; other columns are ignored. A text needs memory in proportion to
    its length.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    ids_as = id_type(Tokenizer.from_str(model).get_vocab_size())
    runs = materialize(token_runs(docs, model, ids_as, key, text))
    offsets = partition_offsets(runs)
    # One row a task of the first pass, which the driver has counted anyway.
    placed = runs.join(F.broadcast(offsets) if offsets.count() <= FEW else offsets, "part")
    placed = placed.select("key", "ids", "n", (F.col("offset") + F.col("before")).alias("at"))
    kind = placed.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_runs(batch, batch.column(2).to_numpy(), OUT_IDS):
                yield pieces(part, length, ids_as)

    schema = f"`{key}` {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return placed.mapInArrow(run, schema).withColumnRenamed("key", key)


def pieces(batch: pa.RecordBatch, length: int, ids_as: str) -> pa.RecordBatch:
    """The pieces of the rows key, ids, n, at: cut where a window of the whole ends."""
    size, at = batch.column(2).to_numpy(), batch.column(3).to_numpy()
    first, last = at // length, (at + size - 1) // length
    n = last - first + 1
    row = np.repeat(np.arange(len(at)), n)
    window = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
    start = np.maximum(window * length - at[row], 0)
    end = np.minimum((window + 1) * length - at[row], size[row])
    flat = np.concatenate([np.frombuffer(x.as_buffer(), dtype=ids_as) for x in batch.column(1)]).astype("<u4")
    cut = np.append(np.cumsum(size)[row] - size[row] + start, len(flat))
    values = start, end - start, size[row], window, at[row] + start - window * length
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(row)), *(pa.array(v.astype(np.int64)) for v in values), binary(cut * 4, flat)],
        names=["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
    )


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The sequences themselves: sequence_id, ids (as bytes), and a boundary record for each piece.

    A boundary says which document begins or goes on at which place; a sequence has at most
    as many as it has ids.
    """
    piece = F.struct("offset", F.col(key).alias("key"), "start", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return rows.select(
        "sequence_id",
        F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["key"].alias(key), x["start"].alias("start"), x["length"].alias("length"))).alias("boundaries"),
    )
