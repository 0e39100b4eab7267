"""Block pruning of the top-k search: exact results, and how many blocks are scored."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evalweave.llm import topk


def brute(rows, wanted, k):
    v = {i: np.floor(1024 * np.asarray(x)).astype(np.int64) for i, x in rows}
    out = []
    for q in wanted:
        best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def clustered(n, d, groups, spread, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, d))
    x = centre[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_clustered_vectors_in_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "FIT", 200)
    x = clustered(1500, 12, 20, 0.1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, x[0].tolist()) for i in range(300)]  # a large group of copies
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("v", F.lit("z")).withColumn("score", F.lit(1)).withColumn("cell", F.lit(2))
    got = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == brute(rows, [i for i, _ in rows if i % 100 == 0], 10)


def test_lengths_and_few_rows(spark):
    rows = [(k, [float(k), 1.0]) for k in range(4)] + [(100 + k, [0.5] * (k + 3)) for k in range(3)] + [(200, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == brute([r for r in rows if len(r[1]) == 2], [0, 200], 10)  # the others have no vector of their length beside them


def test_blocks_scored():
    """On clustered vectors fewer than half of the (query, block) pairs are scored; in the order
    of the rows' ids, without thresholds, all are. The results are the same.
    """
    x = np.floor(1024 * clustered(20_000, 16, 64, 0.08)).astype(np.int64)
    ids = np.arange(len(x))
    queries = ids % 100 == 0
    share, found = [], []
    for placed in (False, True):
        table = pa.table({"vec_id": ids, "v": pa.array(x.tolist(), pa.list_(pa.int64()))})
        first = (ids[:2048], x[:2048]) if placed else None
        if placed:
            centroids = topk.fit_centroids(first[1].astype(float))
            table = pa.Table.from_batches(topk._placed(centroids)(iter(table.to_batches()))).sort_by([("cell", "ascending"), ("near", "ascending")])
        work = []
        out = list(topk._search(ids[queries], x[queries], 10, first, work)(iter(table.select(["vec_id", "v"]).combine_chunks().to_batches())))
        blocks = -(-len(x) // topk.BLOCK)
        share.append(sum(s for _, s in work) / (queries.sum() * blocks))
        rows = pa.Table.from_batches(out).to_pylist()
        found.append(sorted((r["query_id"], -r["score"], r["vec_id"]) for r in rows))
    assert found[0] == found[1]
    print("share of blocks scored, in storage order and placed:", share)
    assert share[1] < 0.5 < share[0]
