"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.sources.scratch import materialize

TASK_ROWS = 100_000  # rows of a table that one task of a join takes at least
LEAST_TASKS = 16


def tasks_for(rows: int) -> int:
    """Tasks for a join or an aggregate over so many narrow rows.

    Used with coalesce, so it only merges shuffle partitions that are nearly empty; a
    table with more rows keeps the partitions that the session asks for.
    """
    return max(LEAST_TASKS, -(-rows // TASK_ROWS))


def components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(id, root) of every id in links (a, b); root is the smallest id of its component.

    Each round points every node at the first of itself and its neighbours in an order
    drawn anew by hashing, follows the pointers once more, and keeps only links between
    different targets. The order is random, so paths of pointers are short and a chain of
    rising ids contracts as fast as any other graph. Aggregates are partial per task, so a
    node with many links is no hot spot. All state is in tables on the shared folder.
    `tasks` merges the partitions of the first step, as tasks_for says.
    """
    links = links.select("a", "b").filter("a <> b").distinct()
    links = materialize(links.coalesce(tasks) if tasks else links)
    edges, names, turn = links, None, 0
    while rows := edges.count():
        k = tasks_for(2 * rows)

        def place(c: str, turn: int = turn) -> Column:
            return F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("place"), F.col(c).alias("id"))

        ends = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = ends.groupBy("a").agg(F.min(place("b")).alias("m"))
        up = materialize(first.select(F.col("a").alias("id"), F.least(F.col("m"), place("a"))["id"].alias("up")).coalesce(k))
        over = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
        up = materialize(up.join(over, "up").select("id", F.col("top").alias("up")).coalesce(k))
        names = materialize(
            up.withColumnRenamed("up", "root") if names is None
            else names.join(up.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("up", "root").alias("root"))
            .coalesce(tasks_for(2 * links.count()))
        )
        a = up.select(F.col("id").alias("a"), F.col("up").alias("ra"))
        b = up.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        edges = materialize(
            edges.join(a, "a").coalesce(k).join(b, "b").coalesce(k).filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct().coalesce(k)
        )
        turn += 1
    if names is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    least = names.groupBy("root").agg(F.min("id").alias("least"))
    return materialize(names.join(least, "root").select("id", F.col("least").alias("root")).coalesce(tasks_for(2 * links.count())))


def extended(known: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root) of the components that `known`, a stored result of this module, has with further links.

    The links are drawn between the known components, so only what they still join is contracted.
    """
    k = tasks_for(2 * (known.count() + links.count()))
    ends = links.join(known.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left").coalesce(k)
    ends = ends.join(known.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left").coalesce(k)
    over = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), k)
    top = over.select(F.col("id").alias("root"), F.col("root").alias("top"))
    old = known.join(top, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return materialize(old.coalesce(k).union(over.join(known.select("id"), "id", "left_anti").select("id", "root").coalesce(k)))
