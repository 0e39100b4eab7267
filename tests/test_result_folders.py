"""Results that several tasks wrote."""

import os

from evalweave.sources import readers as R


def test_newest_finished_folder(spark, tmp_path):
    for i, name in enumerate(("a.json", "b.json", "c.part.json")):
        spark.range(20).repartition(3).write.json(str(tmp_path / name))
        os.utime(tmp_path / name / "_SUCCESS", (1000 + i, 1000 + i))
    (tmp_path / "open.json").mkdir()  # a write that has not ended
    found = R.latest_file(spark, str(tmp_path), "*.json")
    assert found.endswith("/b.json")
    assert spark.read.schema("id long").json(found).count() == 20
    os.utime(tmp_path / "a.json" / "_SUCCESS", (2000, 2000))
    assert R.latest_file(spark, str(tmp_path), "*.json").endswith("/a.json")
