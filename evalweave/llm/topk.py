"""Exact top-k inner products by block-at-a-time pruning.

Vectors are made integer: floor(1024 * x). Rows are ordered by their two nearest centroids
(fitted on FIT rows; every row is placed) and cut into blocks in that order, so a block
holds like vectors. Each block has the largest and smallest value of every dimension, its
mean and radius, and a forward index (the matrix of its vectors). For a query, the sum over
dimensions of the larger of q * max and q * min bounds every score in a block, and so does
q * mean + |q| * radius; the smaller counts. Each task orders its blocks by that bound per
query and scores them in that order until the next bound falls below the k-th score it has,
or below the k-th score among the FIT rows, which is known before; the lists of the tasks
are then merged.

Queries come in groups of bounded size, which tasks receive whole, one group after the
other; the lists of a group are written before the next one. The other rows stay where they
are. So memory is bounded by BLOCK, QUERIES and FIT on tasks and driver, whatever the table
holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.sources.scratch import materialize

BLOCK = 256  # rows of a block
QUERIES = 4096  # queries of a group, about
HELD = 64  # blocks a task orders at a time
FIT = 8192  # rows that centroids and first thresholds come from
CELLS = 256  # centroids
TURNS = 5  # rounds of fitting them
SLACK = 1e-9  # of the size of a bound, for rounding


_TOP = 2**63 - 1


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _apart(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances from each centroid, less the part that is the row's own."""
    return (centroids**2).sum(axis=1) - 2 * (x @ centroids.T)


def fit_centroids(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """At most CELLS centroids of the rows of x, by k-means."""
    centroids = np.random.default_rng(seed).permutation(np.unique(x, axis=0))[:CELLS]
    for _ in range(TURNS):
        cell = _apart(x, centroids).argmin(axis=1)
        n = np.bincount(cell, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def _placed(centroids: np.ndarray):
    """(vec_id, v, cell, near): the nearest and second nearest centroid of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 16 * BLOCK):
                part = batch.slice(lo, 16 * BLOCK)
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1).astype(np.float64)
                apart = _apart(x, centroids)
                order = np.argpartition(apart, min(1, len(centroids) - 1), axis=1)[:, :2]
                order = np.take_along_axis(order, np.take_along_axis(apart, order, axis=1).argsort(axis=1, kind="stable"), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(order[:, 0], pa.int32()), pa.array(order[:, -1], pa.int32())], names=["vec_id", "v", "cell", "near"]
                )

    return run


def _search(query_ids: np.ndarray, queries: np.ndarray, k: int, first: tuple[np.ndarray, np.ndarray] | None = None, work: list[tuple[int, int]] | None = None):
    """Best rows of a task for each query. `first` are ids and vectors of rows of the table; the
    k-th score among them is where scores start to count. `work` receives the number of
    (query, block) pairs offered and scored.
    """
    largest = float(np.abs(queries).max(initial=0)) * queries.shape[1]
    real = queries.astype(np.float64)
    norms = np.sqrt((real**2).sum(axis=1))

    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact products; of Python integers where their sums could pass 62 bits."""
        sums = largest * float(np.abs(b).max(initial=0))
        if sums < 2**53:  # floats are exact
            return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
        return a @ b.T if sums < 2**62 else a.astype(object) @ b.T.astype(object)

    def bounded(held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Upper bounds of each query's scores in each block, rounded up."""
        high = np.stack([m.max(axis=0) for _, m in held]).astype(np.float64)
        low = np.stack([m.min(axis=0) for _, m in held]).astype(np.float64)
        boxes = np.maximum(real, 0) @ high.T + np.minimum(real, 0) @ low.T
        mean = np.stack([m.mean(axis=0, dtype=np.float64) for _, m in held])
        radius = np.array([np.sqrt(((m - c) ** 2).sum(axis=1).max()) for (_, m), c in zip(held, mean, strict=True)])
        balls = real @ mean.T + norms[:, None] * radius
        size = norms[:, None] * np.sqrt(np.maximum(high**2, low**2).sum(axis=1))
        return np.minimum(boxes, balls) + SLACK * size + 1

    def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = product(a, b)
        if found.dtype == object:
            if found.size and max(found.max(), -found.min()) > _TOP:
                raise OverflowError("a score does not fit into 64 bits")
            found = found.astype(np.int64)
        return found

    floor = np.full(len(queries), np.iinfo(np.int64).min)
    if first is not None and len(first[0]) > k:
        known = scores(queries, first[1])
        for q, (i, row) in enumerate(zip(query_ids, known, strict=True)):
            others = row[first[0] != i]
            if len(others) >= k:
                floor[q] = np.partition(others, len(others) - k)[len(others) - k]

    def score(held: list[tuple[np.ndarray, np.ndarray]], best: list) -> None:
        bounds = bounded(held)
        order = np.argsort(-bounds, axis=1, kind="stable")
        active = np.arange(len(queries))
        for turn in range(len(held)):
            at = order[active, turn]
            kth = np.array([max(floor[q], best[q][1][-1]) if len(best[q][1]) >= k else floor[q] for q in active], dtype=np.float64)
            go = bounds[active, at] >= kth  # bounds fall along the order, so a query that stops has finished
            if work is not None:
                work.append((len(queries), int(go.sum())))
            active, at = active[go], at[go]
            if not len(active):
                break
            for block in np.unique(at):
                mine = active[at == block]
                ids, vectors = held[block]
                found = scores(queries[mine], vectors)
                for q, row in zip(mine, found, strict=True):
                    use = (ids != query_ids[q]) & (row >= floor[q])
                    if len(best[q][1]) >= k:
                        use &= row >= best[q][1][-1]
                    if use.any():
                        best[q] = _best(np.concatenate((best[q][0], ids[use])), np.concatenate((best[q][1], row[use])), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                held.append((ids, part.column(1).flatten().to_numpy().reshape(len(ids), -1)))
                if len(held) >= HELD:
                    score(held, best)
                    held = []
        if held:
            score(held, best)
        q = np.repeat(query_ids, [len(b[0]) for b in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int64()), *(pa.array(np.concatenate([np.zeros(0, np.int64), *(b[c] for b in best)]), pa.int64()) for c in range(2))],
            names=["query_id", "vec_id", "score"],
        )

    return run


def integer_vectors(table: DataFrame, vector: str) -> DataFrame:
    """(vec_id, v array<bigint>) of the rows whose vector is whole: not NULL or empty, no
    NULL and no non-finite component. A component that times 1024 passes 63 bits is an error.
    """
    def scaled(c):
        return F.when(F.abs(c * 1024) < 2.0**63, F.floor(c * 1024)).otherwise(F.raise_error(F.lit("a component times 1024 does not fit into 64 bits")).cast("bigint"))

    rows = table.select(F.col("vec_id").cast("bigint"), F.col(vector).cast("array<double>").alias("x"))
    whole = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & whole).select("vec_id", F.transform("x", scaled).alias("v"))


def top_k(table: DataFrame, is_query, k: int = 10, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query row.

    Ties go to the smaller vec_id. Vectors score against those of the same length. Rows
    with the query's own vec_id are no candidates. A repeated query row answers once; a
    repeated candidate counts as often as it occurs. Scores are exact; one beyond 64 bits is an
    error. Empty tables give an empty result.
    """
    rows = materialize(integer_vectors(table, vector))
    queries = rows.filter(is_query).distinct().select("vec_id", "v", F.size("v").alias("d"), F.xxhash64("vec_id", "v").alias("g"))
    lists = []
    for size in queries.groupBy("d").agg(F.count(F.lit(1)).alias("c")).collect():  # one row a vector length
        alike = rows.filter(F.size("v") == size["d"])
        sample = alike.orderBy(F.xxhash64("vec_id", "v")).limit(FIT).toPandas()
        first = sample["vec_id"].to_numpy(np.int64), np.stack([np.asarray(v, np.int64) for v in sample["v"]])
        place = _placed(fit_centroids(first[1].astype(np.float64)))
        # The order ends in vec_id, so the rows of a large cell go to many tasks.
        placed = alike.mapInArrow(place, "vec_id bigint, v array<bigint>, cell int, near int")
        ordered = materialize(placed.repartitionByRange("cell", "near", "vec_id").sortWithinPartitions("cell", "near").select("vec_id", "v"))
        groups = -(-size["c"] // QUERIES)
        for g in range(groups):
            some = queries.filter((F.col("d") == size["d"]) & (F.pmod("g", F.lit(groups)) == g)).select("vec_id", "v").toPandas()
            if some.empty:
                continue
            run = _search(some["vec_id"].to_numpy(np.int64), np.stack([np.asarray(v, np.int64) for v in some["v"]]), k, first)
            lists.append(materialize(ordered.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")))
    if not lists:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a task at most for a query
    ranked = reduce(DataFrame.union, lists).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
