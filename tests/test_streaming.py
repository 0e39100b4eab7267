"""Files that grow, and the merge of what arrives in them."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalweave.sources import growing
from evalweave.streaming import samples


def record(i, text, n=2):
    return json.dumps({"dataset_index": i, "num_samples": 2, "samples": [{"sample_id": k, "completion": text} for k in range(n)]})


def add(path, text):
    with open(path, "ab") as f:
        f.write(text.encode())


def merged(spark, folder, table):
    rows = samples.merged_samples(spark, table).collect()
    assert len({r["dataset_index"] for r in rows}) == len(rows)
    return {r["dataset_index"]: (r["file"], r["samples"][0]["completion"]) for r in rows}


def run(spark, folder, **kw):
    samples.collect_samples(samples.sample_stream(spark, f"{folder}/in", 2, **kw), f"{folder}/table", f"{folder}/ck", buckets=4)


def test_lines_between_agree_with_split(monkeypatch, tmp_path):
    monkeypatch.setattr(growing, "BLOCK", 5)
    rng = random.Random(1)
    for _ in range(60):
        body = "".join(rng.choice("ab\n\né") for _ in range(rng.randrange(60))).encode()
        (tmp_path / "f").write_bytes(body)
        cuts = sorted({0, len(body), *(rng.randrange(len(body) + 1) for _ in range(4))})
        with pa.OSFile(str(tmp_path / "f")) as f:
            got = [x for lo, hi in zip(cuts, cuts[1:]) for x in growing.lines_between(f, lo, hi)]
        want, at = [], 0
        for line in body.split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        assert got == want


def test_appended_lines_arrive_once(spark, tmp_path):
    """Appends to taken files, a line in two parts, a new file, and rounds without news."""
    (tmp_path / "in").mkdir()
    a, b = tmp_path / "in/out.rank00001.jsonl", tmp_path / "in/out.rank00002.jsonl"
    add(a, record(1, "a1") + "\n" + record(2, "a2") + "\n" + record(3, "a3")[:30])
    run(spark, tmp_path)
    assert merged(spark, tmp_path, f"{tmp_path}/table") == {1: (a.name, "a1"), 2: (a.name, "a2")}
    run(spark, tmp_path)
    add(a, record(3, "a3")[30:] + "\n")
    add(b, record(2, "b2") + "\n" + record(9, "few", 1) + "\nno json\n")
    run(spark, tmp_path, split=7)
    assert merged(spark, tmp_path, f"{tmp_path}/table") == {1: (a.name, "a1"), 2: (b.name, "b2"), 3: (a.name, "a3")}
    # a later line of an earlier file does not win over a later file
    add(a, record(2, "late") + "\n" + record(1, "again") + "\n\n")
    add(tmp_path / "in/other.txt", record(5, "x") + "\n")
    run(spark, tmp_path)
    want = {1: (a.name, "again"), 2: (b.name, "b2"), 3: (a.name, "a3")}
    assert merged(spark, tmp_path, f"{tmp_path}/table") == want
    samples.drop_old(spark, f"{tmp_path}/table")
    assert merged(spark, tmp_path, f"{tmp_path}/table") == want
    assert samples.drop_old(spark, f"{tmp_path}/table") == 0


def test_no_files_yet(spark, tmp_path):
    run(spark, tmp_path)
    with pytest.raises(FileNotFoundError):
        samples.merged_samples(spark, f"{tmp_path}/table")
    assert samples.merged_samples(spark, f"{tmp_path}/table", "dataset_index BIGINT").count() == 0


def test_upsert_twice_changes_nothing(spark, tmp_path):
    """A batch that runs again, also after later batches and after a failure between data and commit."""
    def batch(rows):
        return spark.createDataFrame(rows, "dataset_index bigint, file string, at bigint, v string")

    def rows():
        return {r[0]: tuple(r)[1:] for r in samples.merged_samples(spark, table).select("dataset_index", "file", "at", "v").collect()}

    table = f"{tmp_path}/t"
    first = batch([(i, "a", i, f"x{i}") for i in range(50)] + [(7, "a", 99, "x7b"), (None, "a", 3, "no key")])
    second = batch([(i, "b", i, f"y{i}") for i in range(40, 60)])
    samples.upsert(first, 0, table, buckets=5)
    one = rows()
    assert one == {i: ("a", i, f"x{i}") for i in range(50)} | {7: ("a", 99, "x7b"), None: ("a", 3, "no key")}
    samples.upsert(first, 0, table, buckets=5)
    assert rows() == one
    second.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{table}/data/batch=1")  # died before its commit
    assert rows() == one
    samples.upsert(second, 1, table, buckets=5)
    two = rows()
    assert two == one | {i: ("b", i, f"y{i}") for i in range(40, 60)}
    samples.upsert(second, 1, table, buckets=5)
    samples.upsert(first, 0, table, buckets=5)  # replayed late: later versions stay in force
    assert rows() == two
    samples.upsert(batch([]), 2, table, buckets=5)
    assert rows() == two
