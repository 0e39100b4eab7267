"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """One ASCII-escaped JSON object per row."""
    df.write.mode("overwrite").option("writeNonAsciiCharacterAsCodePoint", True).option("ignoreNullFields", False).json(path)


def verified_path(path: str) -> str:
    """Where the verified records of an input file go."""
    for end in (".jsonl", ".json"):
        if path.endswith(end):
            return path[: -len(end)] + "_verified.json"
    return path + "_verified.json"


def write_verified(df: DataFrame, input_path: str, output_path: str | None = None) -> str:
    out = output_path or verified_path(input_path)
    df.write.mode("overwrite").json(out)
    return out


def prepared_path(folder: str, max_length: int, insert_eos: bool, drop_tail: bool) -> str:
    return f"{folder}/max_length-{max_length}-insert_eos-{insert_eos}-drop_tail-{drop_tail}"


def write_prepared(df: DataFrame, path: str, keep: set[str] | None = None) -> None:
    """Prepared rows, one folder per split; `keep` names the columns to keep."""
    cols = [c for c in df.columns if keep is None or c in keep or c == "split"]
    df.select(*cols).write.mode("overwrite").partitionBy("split").parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_jobs(df: DataFrame, source: str, outputs: dict[str, str]) -> None:
    """Write the rows of each source file to the output file it is paired with.

    All rows are dealt out in one pass, into a folder per source beside the outputs; every output
    is then that folder's files under its own name.
    """
    spark = df.sparkSession
    first = next(iter(outputs.values()))
    stage = f"{first.rpartition('/')[0]}/.jobs-{uuid.uuid4().hex}"
    df.withColumn("_job", F.col(source)).write.partitionBy("_job").json(stage)
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(stage).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, out in outputs.items():
        system.delete(place(out), True)
        made = place(f"{stage}/_job={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)}")
        if system.exists(made):
            system.rename(made, place(out))
        else:  # a source without rows has an empty output
            system.mkdirs(place(out))
    system.delete(place(stage), True)
