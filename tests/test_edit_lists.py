"""The edit loss on lists, against the form on rows."""

import pytest
from pyspark.sql import functions as F

from evalweave.operators import edits as E


def _rows(spark, n=3, last=2):
    rates = [(k, p, 0.1 * (p + 1), 0.2, 0.3 + k, -1.0 - p, -2.0) for k in (0, 1) for p in range(n)]
    edits = [(0, 0, "DEL"), (0, 1, "INS"), (0, last, "SUB"), (1, 2, "SUB")]
    return (
        spark.createDataFrame([(0, 3.0, 4, 3), (1, 20.0, 0, 3)], "k long, w double, x1_len int, cur_len int"),
        spark.createDataFrame(rates, "k long, pos long, sub double, del double, ins double, log_sub double, log_ins double"),
        spark.createDataFrame(edits, "k long, pos long, kind string"),
    )


def _lists(pairs, rates, edits):
    names = ("sub", "del", "ins", "log_sub", "log_ins")
    at = rates.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", *names))).alias("r"))
    own = edits.groupBy("k").agg(F.collect_list(F.struct("kind", "pos")).alias("edits"))
    rows = pairs.select("k", F.array(F.struct("w", "x1_len", "cur_len")).alias("members")).join(at, "k").join(own, "k")
    return rows.withColumn("rates", F.struct(*(F.col("r")[c].alias(c) for c in names)))


def test_loss_on_lists_is_the_loss_on_rows(spark):
    tables = _rows(spark)
    want = {r["k"]: (r["survival"], r["positive"]) for r in E.edit_rate_loss(*tables, "k", 10.0).collect()}
    got = {r["k"]: (r["survival"], r["positive"]) for r in E.edit_rate_loss(_lists(*tables), "rates", "edits", "k", 10.0).collect()}
    assert got.keys() == want.keys() == {0, 1}
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_loss_on_lists_fails_out_of_range(spark):
    with pytest.raises(Exception, match="out of range"):
        E.edit_rate_loss(_lists(*_rows(spark, last=3)), "rates", "edits", "k").collect()


def test_pairs_without_lists_count_in_the_loss(spark):
    df = spark.createDataFrame([(0, [7], [8], 1.0, 1, 1), (1, None, [8], 2.0, 1, None), (1, [7], None, 2.0, None, 1)], "k long, zt array<int>, z1 array<int>, w double, x1_len int, cur_len int")
    pairs = E.edits_by_key(df, "k", "zt", "z1", "w", "x1_len", "cur_len")
    names = ("sub", "del", "ins", "log_sub", "log_ins")
    rates = F.when(F.col("k") == 0, F.array(F.lit(0.5))).cast("array<double>")
    terms = E.edit_rate_loss(pairs.withColumn("rates", F.struct(*(rates.alias(n) for n in names))), "rates", "edits", "k")
    got = sorted((r["k"], r["survival"]) for r in terms.collect())
    assert got == [(0, 1.5), (1, 0.0), (1, 0.0)]
