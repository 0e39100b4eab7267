"""Choices over tables of scored tokens and of confidences per position.

Groups are one position's candidates or one sequence's positions, so every
window is bounded by the vocabulary kept per position or the sequence length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.hashing import hash_uniform
from evalweave.operators.noise import LINEAR, reverse_mask_prob

POSITION = ("seq", "pos")


def softmax_scores(df: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Add `prob`, the softmax of the logits of a position."""
    w = Window.partitionBy(*POSITION)
    scaled = F.col("logit") / (temperature if temperature else 1.0)
    return (
        df.withColumn("_top", F.max(scaled).over(w))
        .withColumn("_e", F.exp(scaled - F.col("_top")))
        .withColumn("prob", F.col("_e") / F.sum("_e").over(w))
        .drop("_top", "_e")
    )


def topk_filter(df: DataFrame, k: int) -> DataFrame:
    """Tokens at or above the k-th largest logit of their position, ties kept."""
    return df.withColumn("_r", F.rank().over(Window.partitionBy(*POSITION).orderBy(F.desc("logit")))).filter(
        F.col("_r") <= k
    ).drop("_r")


def nucleus_filter(df: DataFrame, top_p: float) -> DataFrame:
    """Tokens whose probability mass before them is at most top_p; the first stays."""
    order = Window.partitionBy(*POSITION).orderBy(F.desc("logit"), "token").rowsBetween(Window.unboundedPreceding, -1)
    mass = F.coalesce(F.sum("prob").over(order), F.lit(0.0))
    return softmax_scores(df).withColumn("_mass", mass).filter(F.col("_mass") <= top_p).drop("_mass")


def token_confidence(df: DataFrame) -> DataFrame:
    """Per position: best token, its probability, the margin to the next, and the
    sum of p * ln(p).
    """
    p = F.col("prob")
    best = F.struct(p, -F.col("token"))
    first_two = F.slice(F.sort_array(F.collect_list(p), asc=False), 1, 2)
    return (
        softmax_scores(df)
        .groupBy(*POSITION)
        .agg(
            F.max_by("token", best).alias("token"),
            F.max(p).alias("confidence"),
            first_two.alias("_two"),
            F.sum(p * F.log(p + 1e-10)).alias("neg_entropy"),
        )
        .withColumn("margin", F.col("_two")[0] - F.coalesce(F.get("_two", 1), F.lit(0.0)))
        .drop("_two")
    )


def _ranked(df: DataFrame) -> DataFrame:
    """Masked positions of each sequence, ranked by confidence."""
    order = Window.partitionBy("seq").orderBy(F.desc("confidence"), "pos")
    return df.filter("masked").withColumn("_r", F.row_number().over(order))


def reveal_topk(df: DataFrame, k: Column) -> DataFrame:
    """The k most confident masked positions of each sequence."""
    return _ranked(df).filter(F.col("_r") <= k).drop("_r")


def reveal_threshold(df: DataFrame, threshold: float) -> DataFrame:
    """Masked positions at or above the threshold; at least the best one."""
    return _ranked(df).filter((F.col("_r") == 1) | (F.col("confidence") >= threshold)).drop("_r")


def reveal_dynamic(df: DataFrame, factor: float) -> DataFrame:
    """As many of the best positions as pass a bar that rises with the rank."""
    bar = F.when(F.col("_r") == 1, -1.0).otherwise(1.0 - factor / (F.col("_r") + 1.0))
    passed = F.count_if(F.col("confidence") >= bar).over(Window.partitionBy("seq"))
    return _ranked(df).withColumn("_k", passed).filter(F.col("_r") <= F.col("_k")).drop("_r", "_k")


def reveal_threshold_or_topk(df: DataFrame, threshold: float, k: Column) -> DataFrame:
    """All positions above the threshold if there are k of them, else the k best."""
    above = F.count_if(F.col("confidence") > threshold).over(Window.partitionBy("seq"))
    chosen = F.when(F.col("_above") >= k, F.col("confidence") > threshold).otherwise(F.col("_r") <= k)
    return _ranked(df).withColumn("_above", above).filter(chosen).drop("_r", "_above")


def edit_threshold(df: DataFrame, threshold: float) -> DataFrame:
    """Placed tokens outside the prompt that a more confident token replaces."""
    return df.filter(
        ~F.col("masked") & ~F.col("in_prompt") & (F.col("confidence") > threshold) & (F.col("token") != F.col("old_token"))
    )


def even_schedule(block_size: Column, steps: Column) -> Column:
    """Tokens per step, the remainder going to the first steps."""
    base = F.floor(block_size / steps)
    extra = F.pmod(block_size, steps)
    schedule = F.transform(F.sequence(F.lit(1), steps.cast("int")), lambda i: base + F.when(i <= extra, 1).otherwise(0))
    return F.when(steps > 0, schedule).otherwise(F.array().cast("array<bigint>"))


def transfer_schedule(n: Column, steps: int, kind: str = LINEAR) -> Column:
    """Tokens to reveal per step, steps without any left out.

    Each step takes the rounded share of what is left that the schedule gives
    it (halves to even), until nothing is left.
    """

    def step(acc: Column, j: Column) -> Column:
        t, s = (steps - j) / F.lit(steps), (steps - j - 1) / F.lit(steps)
        share = F.rint(acc["left"] * (1 - reverse_mask_prob(s, t, kind))).cast("bigint")
        take = F.least(share, acc["left"])
        return F.struct((acc["left"] - take).alias("left"), F.concat(acc["out"], F.array(take)).alias("out"))

    start = F.struct(n.cast("bigint").alias("left"), F.array().cast("array<bigint>").alias("out"))
    taken = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), start, step, lambda acc: acc["out"])
    return F.filter(taken, lambda x: x > 0)


def noisy_score(logit: Column, temperature: float, *key: Column | str, seed: int = 42) -> Column:
    """exp(logit) over (-ln u)^temperature; the logit itself at temperature 0."""
    if temperature == 0:
        return logit
    u = hash_uniform(seed, *key)
    return F.exp(logit) / F.pow(-F.log(u), F.lit(temperature))
