"""Remaining edits against a plain loop."""

from evalweave.operators import edits as E

PAIRS = [
    (0, [7, -1, 3, 4, 5], [7, 2, -1, 4, 6]),
    (1, [7], [7]),
    (2, [-1, -1, 5, None], [1, 2, 6, 4]),
    (3, [7, 8, 9], [7, -1, -1]),
    (3, [7, -1, 9], [6, 1, 9]),
    (None, [7, 1], [7, 2]),
]


def plain(pairs):
    out = []
    for key in {k for k, _, _ in pairs}:
        seen, own = 0, [(a, b) for k, a, b in pairs if k == key]
        for j in range(max(len(a) for a, _ in own)):
            for a, b in own:
                if j < len(a):
                    x, y = a[j], b[j]
                    if x is not None and y is not None and x != y:
                        kind = "INS" if x == -1 else "DEL" if y == -1 else "SUB"
                        out.append((key, j, kind, max(seen - 1, 0) if kind == "INS" else seen, None if y == -1 else y))
                    seen += x is not None and x != -1
    return sorted(out, key=str)


def test_edits_need_no_rows_per_position(spark):
    df = spark.createDataFrame(PAIRS, "k long, zt array<int>, z1 array<int>")
    edits = E.remaining_edits(df, "k", "zt", "z1")
    assert sorted([tuple(r) for r in edits.select("k", "j", "kind", "pos", "token").collect()], key=str) == plain(PAIRS)
    assert "Window" not in edits._jdf.queryExecution().toString()
