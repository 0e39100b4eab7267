"""Hashes of many positions at once, against one expression per position."""

from pyspark.sql import functions as F

from evalweave.functions import hashing as H
from evalweave.operators import noise as N


def _keys(spark):
    rows = [("a", 0), ("b", 1), (None, 12), ("é" * 40, 1101), ("long" * 30, 25), ("c", 300), ("d", None)]
    return spark.createDataFrame(rows, "k string, n int")


def test_uniforms_are_the_hash_of_each_position(spark):
    at = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.greatest("n", F.lit(1)) - 1)).when(F.col("n") == 0, F.array().cast("array<int>"))
    want = F.transform(at, lambda i: H.hash_uniform(7, F.col("k"), i))
    got = H.hash_uniforms(F.col("n"), u=(7, F.col("k")))
    for r in _keys(spark).select(got["u"].alias("got"), want.alias("want")).collect():
        assert r["got"] == r["want"]


def test_exact_masks_take_the_least_hashes(spark):
    rows = [(1, list(range(30)), 10), (2, [5], 0), (None, list(range(400)), 100), (4, [5, 6], 2)]
    df = spark.createDataFrame(rows, "k long, input_ids array<int>, prompt_len int")
    out = N.mask_noise_exact_k(df, "k", 3)
    assert "sort_array" not in out._jdf.queryExecution().toString()
    place = F.transform(F.sequence(F.lit(0), F.size("input_ids") - F.col("prompt_len") - 1), lambda i: F.struct(H.hash_uniform(42, "pick", F.col("k"), F.col("draw"), i), i.alias("i")))
    taken = F.slice(F.sort_array(place), 1, F.col("n_masked").cast("int"))["i"]
    got = out.select("prompt_len", "masked", taken.alias("taken")).collect()
    assert len(got) == 9
    for r in got:
        assert {i for i, m in enumerate(r["masked"]) if m} == {r["prompt_len"] + i for i in r["taken"]}
