"""Sharding along a Hilbert curve.

Language, source and length are each quantised into 32 buckets of about equal row counts.
Rows are sorted by the Hilbert index of their cell and cut into runs of equal row counts,
so a shard's files span short ranges of all three columns at once and prune on any of them.

Equal texts share one cell (that of the copy with the smallest doc_id) and lie next to each
other in it, so a group of copies is split only where a cut falls into it.

Positions come from a sort by range: each range counts its rows, and the counts give the
offsets. No task sees more than a range, whatever a cell, a source or a group of copies holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.sources.scratch import materialize

BITS = 5
HOT = 4096  # groups of copies with more than this part of all rows, so many at most, are sent to the rows
DIMENSIONS = 3


def curve_sql(cells: str) -> str:
    """(cell, hilbert) of all cells x + 32 y + 1024 z, in SQL (Skilling's transform).

    `cells` is a statement with the column `cell` from 0 to 32^3 - 1.
    """
    axes = ("x", "y", "z")
    xor = lambda a, b: f"(({a} | {b}) - ({a} & {b}))"
    steps = [f"c0 AS (SELECT cell, cell & {2**BITS - 1} AS x, (cell >> {BITS}) & {2**BITS - 1} AS y, (cell >> {2 * BITS}) & {2**BITS - 1} AS z FROM ({cells}) AS cells)"]

    def step(columns: dict[str, str]) -> None:
        n = len(steps)
        kept = ", ".join(f"{columns.get(a, a)} AS {a}" for a in axes)
        steps.append(f"c{n} AS (SELECT cell, {kept} FROM c{n - 1})")

    for bit in range(BITS - 1, 0, -1):  # undo the rotations, high bits first
        q = 1 << bit
        for a in axes:
            low = f"({xor('x', a)} & {q - 1})"
            if a == "x":
                step({"x": f"CASE WHEN x & {q} <> 0 THEN {xor('x', q - 1)} ELSE x END"})
            else:
                step({"x": f"CASE WHEN {a} & {q} <> 0 THEN {xor('x', q - 1)} ELSE {xor('x', low)} END",
                      a: f"CASE WHEN {a} & {q} <> 0 THEN {a} ELSE {xor(a, low)} END"})
    step({"y": xor("y", "x")})  # Gray code
    step({"z": xor("z", "y")})
    mask = "0"
    for bit in range(BITS - 1, 0, -1):
        mask = xor(mask, f"(CASE WHEN z & {1 << bit} <> 0 THEN {(1 << bit) - 1} ELSE 0 END)") if mask != "0" else f"(CASE WHEN z & {1 << bit} <> 0 THEN {(1 << bit) - 1} ELSE 0 END)"
    n = len(steps)
    steps.append(f"c{n} AS (SELECT cell, x, y, z, {mask} AS t FROM c{n - 1})")
    steps.append(f"c{n + 1} AS (SELECT cell, {', '.join(f'{xor(a, chr(116))} AS {a}' for a in axes)} FROM c{n})")
    bits = " + ".join(
        f"((({a} >> {bit}) & 1) << {bit * DIMENSIONS + DIMENSIONS - 1 - k})" for bit in range(BITS) for k, a in enumerate(axes)
    )
    return f"WITH {', '.join(steps)} SELECT cell, {bits} AS hilbert FROM c{n + 1}"


def _offsets(parts: DataFrame, weight: Column) -> Column:
    """What the ranges before a row's range hold, as an expression on `_part`."""
    total, pairs = 0, []
    for part, amount in sorted(parts.groupBy("_part").agg(F.sum(weight)).collect()):  # one row a range
        pairs.append((part, total))
        total += amount
    by_part = F.create_map(*(F.lit(v) for p, t in pairs for v in (p, int(t)))) if pairs else None
    return F.lit(0).cast("bigint") if by_part is None else by_part[F.col("_part")].cast("bigint")


def _ranges(rows: DataFrame, *order: str) -> DataFrame:
    """The rows in order over ranges, with the range of each as `_part`, kept as a table."""
    return materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _cuts(rows: DataFrame, column: str) -> list:
    """The smallest value of each of up to 32 buckets of about equal row counts."""
    values = rows.groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    parts = _ranges(values, column)
    before = Window.partitionBy("_part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    total = parts.agg(F.sum("c")).first()[0]
    if not total:
        return []
    place = _offsets(parts, F.col("c")) + F.coalesce(F.sum("c").over(before), F.lit(0))
    bucket = F.floor(place * 2**BITS / F.lit(total))
    return sorted(r[0] for r in parts.select(bucket.alias("b"), column).groupBy("b").agg(F.min(column)).select(f"min({column})").collect())


def _bucket(column: str, cuts: list) -> Column:
    return F.greatest(F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= F.col(column))) - 1, F.lit(0)) if cuts else F.lit(0)


def hilbert_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert of every row.

    Law `rows`: shard sizes differ by one at most. NULL text counts as empty (size 1); NULL
    language or source sorts as an empty string, NULL length as -1; ties go by text, then
    doc_id; repeated rows all get slots; an empty table gives an empty result. Columns other
    than doc_id, text, lang, source and n_chars are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = materialize(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
            F.coalesce(F.col("n_chars").cast("bigint"), F.lit(-1)).alias("n_chars"),
        )
    )
    cuts = {c: _cuts(rows, c) for c in ("lang", "source", "n_chars")}
    placed = rows
    for c in cuts:
        placed = placed.withColumn(f"b_{c}", _bucket(c, cuts[c]))
    placed = placed.select("doc_id", "size", "text_crc32", "h", (F.col("b_lang") + 2**BITS * F.col("b_source") + 4**BITS * F.col("b_n_chars")).cast("bigint").alias("cell"))
    key = ["h", "text_crc32", "size"]
    copies = materialize(
        placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "cell")).alias("first"))
        .filter("n > 1").select(*key, "n", F.col("first.cell").alias("shared"))
    )
    curve = spark.sql(curve_sql(f"SELECT id AS cell FROM range({2 ** (BITS * DIMENSIONS)})"))
    large = F.col("n") * HOT > rows.count()
    hot = F.broadcast(copies.filter(large).drop("n"))  # HOT rows at most
    placed = placed.join(hot, key).unionByName(placed.join(hot, key, "left_anti").join(copies.filter(~large).drop("n"), key, "left"))
    placed = (
        placed.withColumn("cell", F.coalesce("shared", "cell")).drop("shared")
        .join(F.broadcast(curve), "cell")  # always 32,768 rows
    )
    parts = _ranges(placed, "hilbert", "text_crc32", "h", "doc_id")
    counted = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("c"))
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    least, more = divmod(total, shards)
    within = F.row_number().over(Window.partitionBy("_part").orderBy("hilbert", "text_crc32", "h", "doc_id")) - 1
    at = F.col("_at")
    long_run = more * (least + 1)
    shard = F.when(at < long_run, F.floor(at / F.lit(least + 1))).otherwise(more + F.floor((at - long_run) / F.lit(max(least, 1))))
    ranked = parts.withColumn("_at", _offsets(parts, F.lit(1)) + within).withColumn("shard", shard.cast("int"))
    start = F.when(F.col("shard") <= more, F.col("shard") * (least + 1)).otherwise(F.lit(long_run) + (F.col("shard") - more) * least)
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (at - start).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )
