"""Unions and last-writer-wins merges of output records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat_by_split(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; splits of the same name come together."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def complete_records(df: DataFrame, expected_n: int) -> DataFrame:
    """Records with an index and exactly the expected number of samples."""
    n = F.size(F.coalesce("samples", F.array().cast(df.schema["samples"].dataType)))
    return df.filter(
        F.col("dataset_index").isNotNull() & (F.col("num_samples") == expected_n) & (n == expected_n)
    )


def last_record(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One record per key, the highest by the order columns.

    max_by keeps one record per key and task, so repeated keys shrink before the shuffle.
    """
    rest = [c for c in records.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return records.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")


def merge_rank_outputs(records: DataFrame, key: str = "dataset_index") -> DataFrame:
    """One record per index, the last written one: highest file, then highest line.

    `file_no` is 0 for an existing output and 1.. for rank files.
    """
    return last_record(records, [key], ["file_no", "line_no"])


def rank_progress(complete: DataFrame, targets: DataFrame) -> DataFrame:
    """Complete records per rank against its target, with what is missing."""
    done = complete.groupBy("rank").agg(F.count(F.lit(1)).alias("done"))
    return (
        targets.join(done, "rank", "left")
        .withColumn("done", F.coalesce("done", F.lit(0)))
        .withColumn("missing", F.greatest(F.col("target") - F.col("done"), F.lit(0)))
    )


def join_outputs(problems: DataFrame, outputs: DataFrame, key: str = "dataset_index") -> DataFrame:
    """Problems beside their completions, one row per completion.

    `outputs` holds an array of completions per problem; positions in it are the
    sample ids. Problems without outputs and outputs without a problem drop out.
    """
    rest = [c for c in outputs.columns if c != "completions"]
    long = outputs.select(*rest, F.posexplode("completions").alias("sample_id", "completion"))
    return problems.join(long, key)
