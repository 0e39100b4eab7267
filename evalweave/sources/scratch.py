"""Intermediate tables that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession, folder: str | None = None) -> str:
    """A new folder for intermediate tables, under `folder` or spark.checkpoint.dir.

    That folder must be one that the driver and all executors see. Where neither
    is given, a single-process session (tests) gets a local folder; on a cluster
    it is an error, as every executor would write to a disk of its own.
    """
    shared = folder or spark.conf.get(KEY, None)
    if not shared:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {KEY} to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="run-")
        spark.conf.set(KEY, shared)
    return f"{shared.rstrip('/')}/evalweave/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a table to the shared scratch folder and go on from there.

    The result is computed once and outlives the executors that made it.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, folder) + "/table"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, folder: str | None = None) -> None:
    """Remove everything this application has put under the shared folder."""
    shared = folder or spark.conf.get(KEY, None)
    if shared:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/evalweave/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
