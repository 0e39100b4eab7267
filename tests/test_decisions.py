"""Edit decisions of many rows at once, against a loop over positions."""

import hashlib

from pyspark.sql import functions as F

from evalweave.operators import edits as E


def u(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def test_decisions_and_what_they_make(spark):
    rows = [(k, list(range(100, 100 + n)), k, [(u("d", k, i), u("s", k, i), u("i", k, i), 5, 6) for i in range(n)]) for k, n in ((0, 0), (1, 1), (4, 30), (9, 200))]
    rates = "array<struct<del: double, sub: double, ins: double, sub_token: int, ins_token: int>>"
    df = spark.createDataFrame(rows + [(11, None, 1, None)], f"k long, ids array<int>, prompt_len int, rates {rates}")
    for free in (False, True):
        made = E.decide_edits(df, "k", 0.5, 42, free).select("k", E.apply_edits(F.col("ids"), F.col("decisions")).alias("out"))
        assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()  # no expression per position
        want = {11: None}
        for k, ids, prompt, given in rows:
            upto, out = 0 if free else max(min(prompt, len(ids)), 1), []
            for i, (x, (d, s, a, t, v)) in enumerate(zip(ids, given)):
                d, s, a = (0, 0, a) if i < upto else (d, s, a)
                a = 0 if i < upto - 1 else a
                fires = u(42, "edit", k, i) < min((d + s) * 0.5, 1 - 1e-6)
                if not (fires and u(42, "kind", k, i) < min(d / (d + s + 1e-8), 1)):
                    out.append(t if fires else x)
                if u(42, "insert", k, i) < min(a * 0.5, 1 - 1e-6):
                    out.append(v)
            want[k] = out
        assert {r["k"]: r["out"] for r in made.collect()} == want
