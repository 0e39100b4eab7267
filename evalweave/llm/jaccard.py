"""Exact similarity join on word shingles, in size-banded tiles with bitmap signatures.

Two texts link when 100 * |A n B| >= 80 * |A u B| on their sets of 5-word shingles.

1. One pass over the texts makes, per document, the set size, a 64-bit set hash, a
   1024-bit parity bitmap, for larger sets also one of n to 2n bits, and the set's
   prefix: the n // 5 + 1 first shingles in one global order. Linked sets share a prefix shingle (at most a fifth of either is
   missing from the other). The order is hash order with frequent shingles last;
   which ones are frequent is read off a hashed share of the documents and only
   affects speed, as any order gives the same links.
2. Equal sets become one node. Prefix shingles are sorted by range on (shingle, key),
   so a shingle held by a third of all documents spreads over many tasks. Each run
   of a shingle in a task is a tile: its first set is compared with the others, and
   the tiles of one shingle through their first sets.
3. Every such pair passes the size band (5 min >= 4 max), then the bitmap bound
   (|A xor B| is at least the number of differing bits, and linked sets differ in at
   most (|A| + |B|) / 9 shingles) on the short and then on the wide bitmaps, then the
   exact intersection of sorted arrays. For that, the sets compared with one set travel
   to it in cells of about CELL pairs, so each pair moves one array and not two.
4. Tiles whose sets are then in one component need nothing more. Where sets of one
   shingle lie in different components, other heads are drawn once, and then all their
   remaining pairs go through the same three tests. So no link between two
   components is missed, and a group of thousands of near copies costs about its size,
   not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.frugal import frugal, small_batches
from evalweave.llm.components import components, extended, tasks_for
from evalweave.llm.words import chunks, shingle_sets
from evalweave.sources.scratch import materialize

BITS = 1024
ORDER_SHARE = 16  # one document in so many is read to find frequent shingles
ORDER_SEEN = 4  # documents of that share that must hold a frequent one
CROWD = 12.0  # mean size of a shingle's group (over its rows) up to which all its pairs are compared
ORDER_MOST = 200_000  # frequent shingles that the order knows, the most frequent first

CELL = 256  # pairs with one set that a task compares in a row
FILTER_BITS = 1 << 23  # bits of the filter that spares texts of no pair the shuffle: 131,072 words at most

_SETS = "doc_id bigint, n bigint, h bigint, sig array<bigint>, wide binary, prefix array<bigint>"
_ARRAYS = "a bigint, cell int, member boolean, id bigint, h bigint, shingles binary"


def _set_hash(u: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(u * np.int64(-7046029254386353131), initial=0))


def _wide(u: np.ndarray) -> bytes | None:
    """Parity of the shingles over the least power of two of bits that is not below
    their number; None where the short bitmap is wide enough. A half of that width is
    the exclusive or of its two halves.
    """
    if len(u) <= BITS:
        return None
    bits = 1 << (len(u) - 1).bit_length()
    at = (u.view(np.uint64) >> np.uint64(7)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _signature(rows: list[np.ndarray]) -> np.ndarray:
    """Parity of the shingles per bit: a row of 16 words for each set."""
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    bit = (np.concatenate(rows).view(np.uint64) >> np.uint64(7)) & np.uint64(BITS - 1) if rows else []
    odd = np.bincount(which * BITS + np.asarray(bit, dtype=np.int64), minlength=len(rows) * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(rows), BITS), axis=1).view(np.int64)


def _prefix(u: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    take = len(u) // 5 + 1 if len(u) else 0
    if len(frequent) and take:
        at = np.minimum(np.searchsorted(frequent, u), len(frequent) - 1)
        last = frequent[at] == u
        if last.any():
            return np.concatenate((u[~last], u[last]))[:take]
    return u[:take]


def _sets(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, body, at in chunks(batch.column(1)):
                sets = list(shingle_sets(body, at))
                prefixes = [_prefix(u, frequent) for u in sets]
                cut = np.cumsum([0, *(len(p) for p in prefixes)]).astype(np.int32)
                sig = _signature(sets).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(u) for u in sets], pa.int64()),
                        pa.array([_set_hash(u) for u in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(sig) + 1, 16, dtype=np.int32)), pa.array(sig)),
                        pa.array([_wide(u) for u in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(prefixes))),
                    ],
                    names=["doc_id", "n", "h", "sig", "wide", "prefix"],
                )

    return run


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sorted shingle arrays, as bytes, of the sets that a test needs; rows of the
    same doc_id with another set than the wanted one go.
    """
    for batch in batches:
        for lo, hi, body, at in chunks(batch.column(0)):
            sets = list(shingle_sets(body, at))
            part = batch.slice(lo, hi - lo)
            own = np.array([_set_hash(u) for u in sets], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("a", "cell", "member", "id", "h")), pa.array([u.tobytes() for u in sets], pa.binary())],
                names=["a", "cell", "member", "id", "h", "shingles"],
            ).filter(pa.array(own == part.column("h").to_numpy()))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (token, id, n, pos) rows, those whose shingle occurs again, each with the
    first set of its tile. The first and last tile of a task are kept whole, as they may
    go on in the next task.
    """
    held: pa.RecordBatch | None = None
    first = True

    def out(t, i, n, pos, edge_first: bool, edge_last: bool):
        begin = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        size = np.diff(np.append(begin, len(t)))
        keep = size > 1
        if edge_first:
            keep[0] = True
        if edge_last:
            keep[-1] = True
        rows = np.repeat(keep, size)
        hub, hub_n = np.repeat(i[begin], size), np.repeat(n[begin], size)
        return pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (t, i, n, pos, hub, hub_n)], names=["token", "id", "n", "pos", "hub", "hub_n"])

    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        t, i, n, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        cut = int(np.searchsorted(t, t[-1]))  # the last run may go on in the next batch
        if len(t) - cut > 200_000:  # a long run is emitted as several tiles
            yield out(t, i, n, pos, True, True)
            held, first = None, True
            continue
        if cut:
            yield out(t[:cut], i[:cut], n[:cut], pos[:cut], first, False)
            first = False
        held = batch.slice(cut)
    if held is not None and held.num_rows:
        t, i, n, pos = (held.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        yield out(t, i, n, pos, True, True)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linked pairs (a, b), of rows in the order of a, cell and member: a's own set is first."""
    at, centre = None, {}
    for batch in batches:
        a, cell, member, other, h, body = (batch.column(c) for c in ("a", "cell", "member", "id", "h", "shingles"))
        found: list[tuple[int, int]] = []
        for k, place in enumerate(zip(a.to_pylist(), cell.to_pylist(), strict=True)):
            if place != at:
                at, centre = place, {}
            u = np.frombuffer(body[k].as_buffer(), dtype=np.int64)
            if not member[k].as_py():
                centre[h[k].as_py()] = u
                continue
            for c in centre.values():
                both = len(np.intersect1d(c, u, assume_unique=True))
                if 5 * both >= 4 * (len(c) + len(u) - both):
                    found.append((place[0], other[k].as_py()))
                    break
        yield pa.RecordBatch.from_arrays([pa.array([p[m] for p in found], pa.int64()) for m in (0, 1)], names=["a", "b"])


def _wide_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose wide bitmaps leave room for a link, folded to the lesser width."""
    for batch in batches:
        n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        keep = np.ones(batch.num_rows, dtype=bool)
        for k, (x, y) in enumerate(zip(batch.column("wide_a"), batch.column("wide_b"), strict=True)):
            if x.is_valid and y.is_valid:
                s, t = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                while len(s) > len(t):
                    s = s[: len(s) // 2] ^ s[len(s) // 2 :]
                while len(t) > len(s):
                    t = t[: len(t) // 2] ^ t[len(t) // 2 :]
                keep[k] = 9 * int(np.bitwise_count(s ^ t).sum()) <= n[k]
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _band(n: str, m: str) -> Column:
    return (5 * F.least(n, m)) >= (4 * F.greatest(n, m))


def _bitmaps(s: str, t: str, n: str, m: str) -> Column:
    """Whether the differing bits leave room for a link."""
    differ = sum((F.bit_count(F.col(s)[k].bitwiseXOR(F.col(t)[k])) for k in range(1, BITS // 64)), F.bit_count(F.col(s)[0].bitwiseXOR(F.col(t)[0])))
    return 9 * differ <= F.col(n) + F.col(m)


def _open(tiles: DataFrame, names: DataFrame) -> tuple[DataFrame, float]:
    """Rows of shingles whose sets lie in several components, and the mean size of their groups."""
    k = tasks_for(tiles.count())
    placed = tiles.join(names, "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = materialize(placed.select("token", "id", "n", "pos", "hub", "root").coalesce(k))
    mixed = materialize(
        placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c"))
        .filter("lo <> hi and c > 2").select("token", "c").coalesce(k)
    )
    load = mixed.agg(F.sum(F.col("c") * F.col("c")) / F.sum("c")).first()[0] or 0
    return materialize(placed.join(mixed, "token", "left_semi").coalesce(k)), load


def _ordered(rows: DataFrame, other: str, size: str) -> DataFrame:
    """Distinct pairs (a, b, n_a, n_b) with a < b, of rows with id, n and another set."""
    first = F.col("id") < F.col(other)
    return rows.select(
        F.least("id", other).alias("a"), F.greatest("id", other).alias("b"),
        F.when(first, F.col("n")).otherwise(F.col(size)).alias("n_a"), F.when(first, F.col(size)).otherwise(F.col("n")).alias("n_b"),
    ).distinct()


def _frequent(texts: DataFrame) -> np.ndarray:
    share = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ORDER_SHARE)) == 0)
    seen = (
        share.mapInArrow(frugal(_sets(np.zeros(0, dtype=np.int64))), _SETS)
        .select(F.explode("prefix").alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("c"))
        .filter(F.col("c") >= ORDER_SEEN)
        .orderBy(F.desc("c"), "token").limit(ORDER_MOST)
    )
    return np.sort(np.array([r[0] for r in seen.select("token").collect()], dtype=np.int64))


def _cells(near: DataFrame, k: int) -> DataFrame:
    """Pairs as (a, cell, b), a being the end with more pairs; its pairs lie in cells of about CELL."""
    ends = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    ends = materialize(ends.coalesce(k))
    pairs = near.join(ends.withColumnsRenamed({"id": "a", "c": "c_a"}), "a").coalesce(k)
    pairs = pairs.join(ends.withColumnsRenamed({"id": "b", "c": "c_b"}), "b").coalesce(k)
    swap = F.col("c_b") > F.col("c_a")
    most = F.greatest("c_a", "c_b")
    pairs = pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), most.alias("c"))
    return pairs.select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / CELL)).cast("int").alias("cell"), "b")


def _perhaps(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts without most of those whose doc_id is no id of `wanted`.

    A bitmap of hashed ids goes to all tasks as a table of at most FILTER_BITS / 64 rows,
    whatever the input. More ids make it let more texts pass; the join after it is exact.
    """
    bit = "shiftleft(1L, CAST(place % 64 AS INT))"
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = wanted.select(place.alias("place")).groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(F.expr(bit)).alias("bits"))
    rows = texts.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))).withColumn("word", F.expr("place div 64"))
    return rows.join(F.broadcast(words), "word").filter(f"(bits & {bit}) <> 0").select("doc_id", "text")


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, n_a, n_b) that pass both bitmap bounds and the exact test, as (a, b)."""

    size = nodes.count()

    def beside(rows: DataFrame, column: str, k: int) -> DataFrame:
        narrow = nodes.select("id", column)
        left = rows.join(narrow.withColumnsRenamed({"id": "a", column: f"{column}_a"}), "a").coalesce(k)
        return left.join(narrow.withColumnsRenamed({"id": "b", column: f"{column}_b"}), "b").coalesce(k)

    pairs = materialize(pairs)
    near = beside(pairs, "sig", tasks_for(4 * max(size, pairs.count()))).filter(_bitmaps("sig_a", "sig_b", "n_a", "n_b"))
    near = materialize(near.select("a", "b", "n_a", "n_b"))
    k = tasks_for(4 * max(size, near.count()))
    near = materialize(beside(near, "wide", k).mapInArrow(frugal(_wide_bound), "a bigint, b bigint").distinct().coalesce(k))
    cells = materialize(_cells(near, k))
    wanted = materialize(
        cells.select("a", "cell", F.lit(False).alias("member"), F.col("a").alias("id")).distinct()
        .union(cells.select("a", "cell", F.lit(True), "b"))
        .join(nodes.select("id", "h"), "id").coalesce(k)
    )
    arrays = (
        _perhaps(texts, wanted).join(wanted, F.col("doc_id") == F.col("id")).select("text", "a", "cell", "member", "id", "h")
        .mapInArrow(frugal(_arrays), _ARRAYS)
    )
    placed = arrays.repartition("a", "cell").sortWithinPartitions("a", "cell", "member")
    return materialize(placed.mapInArrow(frugal(_verified), "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sets, nodes, links, names) of a table with doc_id and text.

    `sets` has doc_id, n (set size) and h (set hash) of every row; `nodes` one row per
    distinct non-empty set: id (its smallest doc_id), n, h; `links` pairs of node ids
    whose components are the components of all links; `names` has id and root of every
    node in them.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    sets = materialize(texts.mapInArrow(frugal(_sets(_frequent(texts))), _SETS))
    ids = sets.filter("n > 0").groupBy("h", "n").agg(F.min("doc_id").alias("id"))
    k = tasks_for(4 * sets.count())
    members = materialize(sets.filter("n > 0").select("doc_id", "h", "n").join(ids, ["h", "n"]).coalesce(k))
    gone = members.filter("doc_id <> id OR doc_id IS NULL").select("doc_id", "h", "n").distinct()
    own = sets.filter("n > 0 AND doc_id IS NOT NULL").join(gone, ["doc_id", "h", "n"], "left_anti").withColumnRenamed("doc_id", "id")
    nodes = materialize(own.select("id", "n", "h", "sig", "wide").dropDuplicates(["id", "h", "n"]).coalesce(k))

    # One order of sets for all shingles: the sets of a group of near copies meet the same head.
    rows = own.select("n", "id", F.posexplode("prefix").alias("pos", "token"))
    key = F.xxhash64("id")
    tiles = materialize(
        rows.repartitionByRange("token", key).sortWithinPartitions("token", key).select("token", "id", "n", "pos")
        .mapInArrow(frugal(_tiles), "token bigint, id bigint, n bigint, pos int, hub bigint, hub_n bigint")
    )
    k = tasks_for(tiles.count())
    heads = materialize(tiles.select("token", F.col("hub").alias("id"), F.col("hub_n").alias("n")).distinct().coalesce(k))
    top = heads.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "n")).alias("top")).filter("c > 1")
    over = heads.join(top, "token").select("id", "n", F.col("top.id").alias("hub"), F.col("top.n").alias("hub_n"))
    star = tiles.select("id", "n", "hub", "hub_n").union(over).filter("id <> hub").filter(_band("n", "hub_n"))
    links = _links(_ordered(star, "hub", "hub_n").coalesce(k), nodes, texts)
    names = components(links, tasks_for(links.count()))

    # What the heads did not connect: shingles that still join two components. Where their
    # groups are large, each set is compared with a random one of each of its shingles first.
    open_rows, load = _open(tiles, names)
    if load > CROWD:
        pick = F.min(F.struct(F.xxhash64("id", "token").alias("k"), F.col("id").alias("o"), F.col("n").alias("m"), F.col("root").alias("r"))).alias("pick")
        drawn = open_rows.groupBy("token").agg(pick).select("token", "pick.*")
        met = open_rows.join(drawn, "token").filter("root <> r").filter(_band("n", "m"))
        more = _links(_ordered(met, "o", "m").coalesce(k), nodes, texts)
        links, names = links.union(more), extended(names, more)
        open_rows, _ = _open(tiles, names)
    # Then all pairs that remain, where the bitmaps allow it.
    # The smaller set of a linked pair shows a common shingle in its first ninth already.
    marked = open_rows.join(nodes.select("id", "sig").dropDuplicates(["id"]), "id")
    x, y = marked.alias("x"), marked.alias("y")
    early = F.when(F.col("x.n") <= F.col("y.n"), F.col("x.pos") * 9 <= F.col("x.n")).otherwise(F.col("y.pos") * 9 <= F.col("y.n"))
    rest = x.join(
        y,
        (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & early
        & _band("x.n", "y.n") & (F.col("x.hub") != F.col("y.id")) & (F.col("y.hub") != F.col("x.id"))
        & _bitmaps("x.sig", "y.sig", "x.n", "y.n"),
    ).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).distinct()
    last = _links(rest, nodes, texts)
    return sets.select("doc_id", "n", "h"), nodes.select("id", "n", "h"), links.union(last), extended(names, last)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    component_id is the smallest doc_id that links reach, the row's own included.
    NULL or empty texts have no shingles and link with nothing; equal texts are in
    one component; repeated rows stay, and rows of one doc_id are one document; a NULL
    doc_id stays NULL; an empty table gives an empty result; columns other than doc_id
    and text are ignored.
    """
    sets, nodes, _, names = jaccard_links(docs)
    named = nodes.join(names, "id", "left").select("h", "n", F.coalesce("root", "id").alias("component_id"))
    full = sets.filter("n > 0").join(named, ["h", "n"], "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    none = sets.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.union(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
