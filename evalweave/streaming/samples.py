"""Sample files that ranks keep appending to, merged as they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.operators.merge import last_record
from evalweave.sources.growing import SPLIT, growing_lines
from evalweave.sources.readers import RECORD, parse_records

BUCKETS = 64


def sample_stream(spark: SparkSession, folder: str, expected_n: int, schema: str = RECORD, pattern: str = "*.jsonl", split: int = SPLIT) -> DataFrame:
    """Complete records of JSON-lines files as lines are added to them, with the file and the
    byte each line begins at. Lines that are no complete record are passed over.
    """
    return parse_records(growing_lines(spark, folder, pattern, split), "line", expected_n, schema)


def collect_samples(stream: DataFrame, table: str, checkpoint: str, key: str = "dataset_index", buckets: int = BUCKETS) -> None:
    """Merge what has arrived into a table and stop; a restart goes on from the checkpoint.

    The table holds one record per key, the last written one: highest file, then highest byte.
    """
    query = (
        stream.writeStream.foreachBatch(lambda rows, batch: upsert(rows, batch, table, key, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def current(spark: SparkSession, table: str, before: int | None = None) -> dict[int, int]:
    """bucket -> the batch that wrote it last, by the batches committed (before a given one)."""
    if not _exists(spark, f"{table}/commits"):
        return {}
    rows = spark.read.schema("bucket INT, batch BIGINT").parquet(f"{table}/commits")
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    return {r["bucket"]: r["batch"] for r in rows.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}  # one row a bucket


def _read(spark: SparkSession, table: str, versions: dict[int, int], schema) -> DataFrame:
    paths = [f"{table}/data/batch={batch}/bucket={bucket}" for bucket, batch in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(rows: DataFrame, batch: int, table: str, key: str = "dataset_index", buckets: int = BUCKETS) -> None:
    """Merge a micro-batch into the table, by buckets of the hashed key.

    Only the buckets that the batch touches are written again, each under the batch's own
    number, from the versions committed before it; a list of the buckets, written last, commits
    the batch. A batch that runs again, after a failure or by a replay, thus reads what it read
    and overwrites what it wrote. Versions that no later batch can read any more stay until
    `drop_old` removes them.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    newest = last_record(marked, [key, "bucket"], ["file", "at"]).select(*rows.columns, "bucket")
    touched = {r["bucket"] for r in newest.select("bucket").distinct().collect()}  # at most `buckets` numbers
    if not touched:
        return
    before = {b: v for b, v in current(spark, table, batch).items() if b in touched}
    schema = rows.schema
    known = _read(spark, table, before, schema).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    merged = last_record(known.unionByName(newest), [key, "bucket"], ["file", "at"]).select(*rows.columns, "bucket")
    merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/data/batch={batch}")
    done = spark.createDataFrame([(b,) for b in sorted(touched)], "bucket INT")
    done.coalesce(1).write.mode("overwrite").parquet(f"{table}/commits/batch={batch}")


def merged_samples(spark: SparkSession, table: str, schema=None) -> DataFrame:
    """The last written record per key over everything collected so far, as last committed."""
    versions = current(spark, table)
    if schema is None:
        if not versions:
            raise FileNotFoundError(f"nothing has been collected in {table}")
        schema = spark.read.parquet(f"{table}/data/batch={max(versions.values())}").drop("bucket").schema
    return _read(spark, table, versions, schema)


def drop_old(spark: SparkSession, table: str) -> int:
    """Delete the files of buckets that a later batch replaced, but for the last two batches, which
    may run again; gives the number of folders deleted.
    """
    live = current(spark, table)
    if not live:
        return 0
    last = max(live.values())
    kept = set(live.items()) | set(current(spark, table, last).items())
    gone = 0
    rows = spark.read.schema("bucket INT, batch BIGINT").parquet(f"{table}/commits").filter(F.col("batch") < last - 1)
    for r in rows.distinct().toLocalIterator():
        if (r["bucket"], r["batch"]) not in kept:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/data/batch={r['batch']}/bucket={r['bucket']}")
            gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone
