"""Readers. Every reader states its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.operators.metrics import COUNTERS

SAMPLE = "STRUCT<sample_id: INT, completion: STRING, raw_completion: STRING, reasoning: STRING, complete_lean_proof_section: STRING, " \
    "lean_code_block: STRING, candidate_source: STRING, verification_source: STRING>"
_COUNTED = ", ".join(f"{c}: {'DOUBLE' if c == 'wall_seconds' or c.endswith('flops') else 'BIGINT'}" for c in COUNTERS)
#: Counters of a record, and of each batch its samples were made in.
METRICS = f"STRUCT<{_COUNTED}, batch_metrics: ARRAY<STRUCT<{_COUNTED}>>>"
RECORD = (
    "dataset_index BIGINT, name STRING, informal_prefix STRING, formal_statement STRING, "
    f"prompt_formal_statement STRING, num_samples BIGINT, samples ARRAY<{SAMPLE}>, generation_metrics {METRICS}"
)
CORRUPT = "_corrupt"


def json_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records of JSON lines, or of files that each are one JSON array.

    The name does not tell them apart (verified records are lines under a `.json`
    name): an array starts with `[`, so the first line that is not blank decides.
    Lines split over tasks; an array file is read by one task per file, so keep
    large data in lines.
    """
    reader = spark.read.schema(schema)
    if path.endswith(".jsonl"):
        return reader.json(path)
    first = spark.read.text(path).select(F.ltrim("value").alias("value")).filter("value <> ''").select(F.left("value", F.lit(1))).first()
    return reader.option("multiLine", first is not None and first[0] == "[").json(path)


def json_tolerant(spark: SparkSession, paths: str | list[str], expected_n: int, schema: str = RECORD) -> DataFrame:
    """Complete records of JSON-lines files; undecodable lines drop out."""
    from evalweave.operators.merge import complete_records

    rows = (
        spark.read.schema(f"{schema}, {CORRUPT} STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(paths)
    )
    return complete_records(rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), expected_n)


def parse_records(lines: DataFrame, line: str, expected_n: int, schema: str = RECORD) -> DataFrame:
    """The same on a table that holds each line as text beside other columns."""
    from evalweave.operators.merge import complete_records

    parsed = F.from_json(F.col(line), f"{schema}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT})
    rest = [c for c in lines.columns if c != line]
    rows = lines.select(*rest, parsed.alias("_r")).filter(F.col("_r").isNotNull() & F.col(f"_r.{CORRUPT}").isNull())
    return complete_records(rows.select(*rest, "_r.*").drop(CORRUPT), expected_n)


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """Path of the newest result that matches a name pattern, leaving out `.part` names.

    A result is a file, or a folder that Spark has finished writing, as old as its `_SUCCESS`
    mark. Only the listing is read (path and time), never the contents.
    """
    names = spark._jvm.org.apache.hadoop.fs
    place = names.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for entry in system.listStatus(place, names.GlobFilter(pattern)) if system.exists(place) else ():
        path = entry.getPath()
        if ".part" in path.getName() or path.getName()[0] in "._":
            continue
        mark = names.Path(path, "_SUCCESS") if entry.isDirectory() else path
        if not entry.isDirectory() or system.exists(mark):
            found.append((system.getFileStatus(mark).getModificationTime(), path.toString()))
    if not found:
        raise FileNotFoundError(f"no file matches {pattern!r} in {folder}")
    return max(found)[1]


def csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, every column as text, so leading zeros stay."""
    return spark.read.schema(", ".join(f"`{c}` STRING" for c in columns)).csv(path, header=True)


def preprocessed(spark: SparkSession, path: str) -> DataFrame:
    """A prepared dataset, partitioned by split."""
    return spark.read.parquet(path)


def file_jobs(inputs: list[str] | str | None, outputs: list[str] | str | None) -> list[tuple[str, str | None]]:
    """Pair input files with output files and check their counts."""
    files = [inputs] if isinstance(inputs, str) else list(inputs or [])
    if not files:
        raise ValueError("at least one input file is needed")
    if outputs is None:
        return [(f, None) for f in files]
    if isinstance(outputs, str):
        if len(files) > 1:
            raise ValueError("one output file goes with one input file only")
        return [(files[0], outputs)]
    if len(outputs) != len(files):
        raise ValueError("there must be as many output files as input files")
    return list(zip(files, outputs))


def read_jobs(spark: SparkSession, files: list[str], schema: str = RECORD) -> DataFrame:
    """Records of many files in one table, with the file each came from."""
    return spark.read.schema(schema).json(files).withColumn("source_file", file_name())


def file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
