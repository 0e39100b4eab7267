"""Exact global positions, running totals and cuts without a one-task sort.

A plain `row_number() over (order by key)` moves the whole table into one task. Here the
keys alone are sorted into ranges of a set number of rows, as many as the rows ask for;
counts per range give each range's offset, and only the work inside a range needs an
order. The sorted keys are written once, so every later step sees the same ranges. Whole
rows meet their positions by a join on the key, which is unique, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.sources.scratch import materialize

RANGE_ROWS = 100_000  # rows of a range, about
BLOCK = 1024  # ranges whose totals are summed up in one group
FEW = 1 << 20  # rows of a table of range offsets up to which it is broadcast
CUT_ROWS = 10_000  # rows that are sorted to find a cut
STEPS = 1024  # parts into which a round of narrowing divides what is left

_BEFORE = (Window.unboundedPreceding, -1)


def sorted_ranges(df: DataFrame, order: Sequence[str | Column], range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """The rows, stored, with `_range` and the 0-based `_place` in it, and the number of ranges, which
    follow each other in order.

    The number of ranges follows the rows. Sort columns that are unique together make the result unique.
    """
    ranges = max(1, -(-df.count() // range_rows))
    ordered = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # The id counts the rows of a task from 0 and has the task's number above its 33rd bit.
    stored = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()))
    placed = stored.select("*", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place"))
    return placed.drop("_at"), ranges


def range_starts(rows: DataFrame, total: Column) -> DataFrame:
    """_range, _start: the sum of `total` over all earlier ranges, summed up in blocks of ranges."""
    totals = rows.groupBy("_range").agg(total.alias("_n")).withColumn("_block", F.expr(f"_range div {BLOCK}"))
    inside = F.sum("_n").over(Window.partitionBy("_block").orderBy("_range").rowsBetween(*_BEFORE))
    blocks = totals.groupBy("_block").agg(F.sum("_n").alias("_n"))
    over = F.sum("_n").over(Window.orderBy("_block").rowsBetween(*_BEFORE))  # a row for each BLOCK * RANGE_ROWS rows
    above = blocks.select("_block", F.coalesce(over, F.lit(0)).alias("_above"))
    return totals.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(above, "_block").select("_range", (F.col("_above") + F.col("_inside")).alias("_start"))


def _with_starts(rows: DataFrame, ranges: int, total: Column) -> DataFrame:
    starts = range_starts(rows, total)
    return rows.join(F.broadcast(starts) if ranges <= FEW else starts, "_range")


def ranked(df: DataFrame, order: Sequence[str | Column], out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows with their dense 0-based position in the order, by ranges; meant for narrow tables."""
    placed = _with_starts(*sorted_ranges(df, order, range_rows), F.count(F.lit(1)))
    return placed.withColumn(out, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def _same(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in columns])


def prefix_totals(
    df: DataFrame,
    key: str,
    out: str,
    value: Column | None = None,
    by: Sequence[str] = (),
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add the sum of `value` over all earlier rows of the group, in key order.

    `key` is unique within a group. Without `value` the result is the dense 0-based
    position. Only the key, the group and the value are sorted.
    """
    keys = [*by, key]
    narrow = df.select(*keys, *([] if value is None else [F.coalesce(value, F.lit(0)).alias("_v")]))
    rows, ranges = sorted_ranges(narrow, keys, range_rows)
    if value is None:
        inside, total = F.col("_place"), F.count(F.lit(1))
    else:
        earlier = Window.partitionBy("_range").orderBy("_place").rowsBetween(*_BEFORE)
        inside, total = F.coalesce(F.sum("_v").over(earlier), F.lit(0)), F.sum("_v")
    placed = _with_starts(rows, ranges, total).withColumn(out, F.col("_start") + inside)
    if by:
        first = placed.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(F.min_by(out, F.struct("_range", "_place")).alias("_first"))
        placed = placed.join(first, _same(by), "left").withColumn(out, F.col(out) - F.col("_first"))
    if set(df.columns) <= set(keys):
        return placed.select(*df.columns, out)
    found = placed.select(*[F.col(c).alias(f"_k_{c}") for c in keys], out)
    return df.join(found, _same(keys), "left").select(*df.columns, out)


# ---- cuts ----------------------------------------------------------------------

#: Which rows a cut counts (None: all), and how many of them it wants, by their number.
Cut = tuple[Column | None, Callable[[int], int]]


def nth_keys(df: DataFrame, key: str, cuts: dict[str, Cut], order: Column | None = None, cut_rows: int = CUT_ROWS) -> dict:
    """For each cut the key of the last row it wants, in key order; None if it wants no row.

    `key` is an integer column. Counts of equal parts of the key's range narrow all cuts at
    once, round by round, until a part holds at most `cut_rows` rows; only those are sorted. With
    `order`, a column that sorts as the key does and also tells equal keys apart, its values are
    returned. Rows without a key are in no cut. At most STEPS counts a cut reach the driver.
    """
    names = list(cuts)
    held = [F.lit(True) if cuts[n][0] is None else F.coalesce(cuts[n][0], F.lit(False)) for n in names]
    rows = df.select(F.col(key).cast("bigint").alias("_n"), (F.col(key) if order is None else order).alias("_o"), *[c.alias(f"_c{i}") for i, c in enumerate(held)])
    rows = rows.filter("_n IS NOT NULL")
    own = [F.when(F.col(f"_c{i}"), F.col("_n")) for i in range(len(names))]
    seen = rows.agg(*[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(own) for f in (F.count, F.min, F.max)]).first()
    state, out = {}, dict.fromkeys(names)
    for i, name in enumerate(names):
        total = seen[f"count{i}"]
        rank = min(cuts[name][1](total), total)
        if rank > 0:
            state[i] = [rank, seen[f"min{i}"], seen[f"max{i}"], total]
    while wide := {i: s for i, s in state.items() if s[3] > cut_rows and s[2] > s[1]}:
        parts = []
        for i, (_, lo, hi, _) in wide.items():
            kind = "bigint" if max(abs(lo), abs(hi)) < 1 << 61 else "decimal(38,0)"
            step = (hi - lo) // STEPS + 1
            part = F.expr(f"CAST((CAST(_n AS {kind}) - CAST('{lo}' AS {kind})) div CAST('{step}' AS {kind}) AS INT)")
            parts.append(F.when(F.col(f"_c{i}") & F.col("_n").between(lo, hi), F.struct(F.lit(i).alias("i"), part.alias("part"))))
        counts = rows.select(F.explode(F.array_compact(F.array(*parts))).alias("p")).groupBy("p.i", "p.part").agg(F.count(F.lit(1)).alias("n")).collect()
        for i, (rank, lo, hi, _) in wide.items():
            step = (hi - lo) // STEPS + 1
            for part, n in sorted((r["part"], r["n"]) for r in counts if r["i"] == i):
                if rank <= n:
                    state[i] = [rank, lo + part * step, min(lo + (part + 1) * step - 1, hi), n]
                    break
                rank -= n
    if order is None:
        out |= {names[i]: lo for i, (_, lo, hi, _) in state.items() if lo == hi}
    open_ = {i: s for i, s in state.items() if out[names[i]] is None}
    if open_:
        parts = [F.when(F.col(f"_c{i}") & F.col("_n").between(lo, hi), F.lit(i)) for i, (_, lo, hi, _) in open_.items()]
        left = rows.select("_o", F.explode(F.array_compact(F.array(*parts))).alias("i"))
        place = F.row_number().over(Window.partitionBy("i").orderBy("_o"))
        wanted = reduce(lambda a, b: a | b, [(F.col("i") == i) & (F.col("r") == s[0]) for i, s in open_.items()])
        out |= {names[r["i"]]: r["_o"] for r in left.withColumn("r", place).filter(wanted).select("i", "_o").collect()}
    return out


def up_to(column: Column, last) -> Column:
    """Whether a row is at or before a cut; never NULL."""
    return F.lit(False) if last is None else F.coalesce(column <= F.lit(last), F.lit(False))


def head_rows(df: DataFrame, key: str, want: Callable[[int], int]) -> DataFrame:
    """The first rows in key order; `want` maps the row count to how many.

    The table itself is filtered in place by the cut key, without a shuffle.
    """
    last = nth_keys(df, key, {"head": (None, want)})["head"]
    return df.filter(F.lit(False) if last is None else F.col(key) <= F.lit(last))
