"""Schedules, masking noise, loss weights and likelihood accounting.

Random draws are hash uniforms of (seed, row, position), so they repeat.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import arrays as A
from evalweave.functions.hashing import hash_least, hash_uniform
from evalweave.operators.tokens import IGNORE, MASK

HALF_PI = math.pi / 2
LINEAR, COSINE, CUBIC = "linear", "cosine", "cubic"


def _checked(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def _in_unit(t: Column, value: Column) -> Column:
    return _checked((t >= 0) & (t <= 1), value, "time is not in [0, 1]")


# ---- schedules ---------------------------------------------------------------


def alpha(t: Column, kind: str = LINEAR) -> Column:
    """Share of tokens kept at time t."""
    if kind == LINEAR:
        return _in_unit(t, 1 - t)
    if kind == COSINE:
        return _in_unit(t, 1 - F.cos(HALF_PI * (1 - t)))
    raise ValueError(f"unknown schedule {kind!r}")


def alpha_derivative(t: Column, kind: str = LINEAR) -> Column:
    if kind == LINEAR:
        return _in_unit(t, F.lit(-1.0))
    if kind == COSINE:
        return _in_unit(t, -HALF_PI * F.sin(HALF_PI * (1 - t)))
    raise ValueError(f"unknown schedule {kind!r}")


def alpha_weight(t: Column, kind: str = LINEAR) -> Column:
    return -alpha_derivative(t, kind) / (1 - alpha(t, kind) + 1e-6)


def reverse_mask_prob(s: Column, t: Column, kind: str = LINEAR) -> Column:
    """Probability that a token masked at t is still masked at s < t."""
    ok = (s >= 0) & (s < 1) & (t > 0) & (t <= 1) & (s < t)
    return _checked(ok, (1 - alpha(s, kind)) / (1 - alpha(t, kind)), "0 <= s < t <= 1 does not hold")


def kappa(t: Column, kind: str = CUBIC, a: float = 1.0, b: float = 1.0) -> Column:
    """Share of the target mixed in at time t."""
    if kind == CUBIC:
        return _in_unit(t, (a + 1) * t * t * t - (a + b + 1) * t * t + (b + 1) * t)
    if kind == LINEAR:
        return _in_unit(t, t)
    if kind == COSINE:
        return _in_unit(t, 1 - F.cos(HALF_PI * t))
    raise ValueError(f"unknown schedule {kind!r}")


def kappa_derivative(t: Column, kind: str = CUBIC, a: float = 1.0, b: float = 1.0) -> Column:
    if kind == CUBIC:
        return _in_unit(t, 3 * (a + 1) * t * t - 2 * (a + b + 1) * t + (b + 1))
    if kind == LINEAR:
        return _in_unit(t, F.lit(1.0))
    if kind == COSINE:
        return _in_unit(t, HALF_PI * F.sin(HALF_PI * t))
    raise ValueError(f"unknown schedule {kind!r}")


def kappa_weight(t: Column, kind: str = CUBIC, a: float = 1.0, b: float = 1.0) -> Column:
    return kappa_derivative(t, kind, a, b) / (1 - kappa(t, kind, a, b) + 1e-6)


# ---- masking -----------------------------------------------------------------


def mask_noise(
    df: DataFrame, key: str, seed: int = 42, epsilon: float = 1e-3, kind: str = LINEAR, mask_id: int = MASK
) -> DataFrame:
    """Mask each token with probability 1 - alpha(t) at a random time per row.

    Tokens whose label is ignored stay. Adds `t`, `p_mask`, `masked` and `noised_ids`.
    """

    def hits(p: Column) -> Column:
        return F.transform(
            "labels", lambda x, i: (x != IGNORE) & (hash_uniform(seed, "mask", F.col(key), i) < p)
        )

    return (
        df.withColumn("t", epsilon + (1 - epsilon) * hash_uniform(seed, "time", F.col(key)))
        .withColumn("p_mask", 1 - alpha(F.col("t"), kind))
        .withColumn("masked", A.let(F.col("p_mask"), hits))
        .withColumn("noised_ids", A.put_where("input_ids", "masked", mask_id))
    )


def mask_noise_rl(df: DataFrame, key: str, p_mask_prompt: float, seed: int = 42, mask_id: int = MASK) -> DataFrame:
    """Mask the whole completion, and prompt tokens with a probability."""

    n = F.least(F.col("prompt_len"), F.size("input_ids"))

    def value(x: Column, i: Column) -> Column:
        return F.when(hash_uniform(seed, "prompt", F.col(key), i) < p_mask_prompt, mask_id).otherwise(x)

    prompt = F.transform(A.head(F.col("input_ids"), n), value)
    return df.withColumn("noised_ids", F.concat(prompt, A.fill(mask_id, F.size("input_ids") - n)))


def mask_noise_exact_k(df: DataFrame, key: str, draws: int, seed: int = 42, mask_id: int = MASK) -> DataFrame:
    """`draws` copies of each row that mask exactly x target tokens each.

    x steps through the target length over the draws from a random start. The x
    tokens with the least hash are taken, found inside the row in Arrow batches.
    """
    n, prompt = F.col("_n"), F.col("prompt_len")
    k = F.floor(hash_uniform(seed, "k", F.col(key)) * n) + 1
    x = F.rint(F.col("_k") + F.col("draw") * (n / draws)).cast("bigint")

    hits = hash_least(n, F.col("n_masked"), seed, "pick", F.col(key), F.col("draw"))
    return (
        df.withColumn("_n", F.size("input_ids") - prompt)
        .filter(n > 0)
        .withColumn("_k", k)
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("n_masked", F.pmod(x - 1, n) + 1)
        .withColumn("p_mask", F.col("n_masked") / n)
        .withColumn("masked", F.concat(F.array_repeat(F.lit(False), prompt.cast("int")), hits))
        .withColumn("noised_ids", A.put_where("input_ids", "masked", mask_id))
        .drop("_n", "_k")
    )


def mask_noise_stratified(
    df: DataFrame, key: str, draws: int, epsilon: float = 1e-3, seed: int = 42, mask_id: int = MASK
) -> DataFrame:
    """`draws` copies of each row with evenly spread times; both ends stay."""
    t = F.col("t")

    def hits(p: Column) -> Column:
        last = F.size("input_ids") - 1
        return A.let(
            last,
            lambda z: F.transform(
                "input_ids",
                lambda _, i: (i > 0) & (i < z) & (hash_uniform(seed, "mask", F.col(key), F.col("draw"), i) < p),
            ),
        )

    return (
        df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("t", F.pmod(hash_uniform(seed, "u0", F.col(key)) + F.col("draw") / draws, F.lit(1.0)))
        .withColumn("p_mask", (1 - epsilon) * t + epsilon)
        .withColumn("masked", A.let(F.col("p_mask"), hits))
        .withColumn("noised_ids", A.put_where("input_ids", "masked", mask_id))
    )


# ---- weights -----------------------------------------------------------------


def with_cart_weights(df: DataFrame, masked: str = "masked", out: str = "cart_weight", p: float = 0.3) -> DataFrame:
    """Add the weight of each masked position of a row (0 at unmasked ones).

    The weight is half the geometric weights p * (1-p)^(d-1) of all unmasked
    positions at distance d. It is a running sum with decay from either side,
    which no array function has, so it runs in Arrow batches inside the task:
    rows stay whole and nothing is shuffled.
    """
    if not 0.0 < p < 1.0:
        raise ValueError("p must be between 0 and 1")

    @F.arrow_udf("array<double>")
    def weigh(rows: pa.Array, sizes: pa.Array) -> pa.Array:
        n = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        border = np.concatenate(([0], np.cumsum(n)))
        weights = _cart(rows.flatten().fill_null(False).to_numpy(zero_copy_only=False), border, p)
        return pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(weights), mask=rows.is_null())

    # Both marks keep the call on its own: with a second use of the array the
    # optimizer leaves the array a column, and a call that is not deterministic
    # is not moved into a lambda of a later step.
    return df.withColumn(out, weigh.asNondeterministic()(F.col(masked), F.size(masked)))


def _cart(masked: np.ndarray, border: np.ndarray, p: float) -> np.ndarray:
    """The weights of all rows, given as one flat array and their borders."""
    seen = (~masked).astype(float)
    near = _decayed(seen, border, 1.0 - p) + _decayed(seen[::-1], border[-1] - border[::-1], 1.0 - p)[::-1]
    return np.where(masked, 0.5 * p * near, 0.0)


def _decayed(x: np.ndarray, border: np.ndarray, q: float) -> np.ndarray:
    """For each i the sum over earlier j of its row of x[j] * q^(i-j-1).

    One scan runs over all rows: terms are scaled by powers of q inside blocks short enough for
    doubles, and what a block hands on decays to nothing within the next one. What earlier
    rows hand on to a row, the scan at its border, is then taken off with its own decay.
    """
    if not len(x):
        return x
    block = min(max(1, int(120 / -math.log10(q))), len(x))
    n = -(-len(x) // block)
    grid = np.zeros(n * block)
    grid[: len(x)] = x
    grid = grid.reshape(n, block)
    at = np.arange(block)
    scaled = np.cumsum(grid * q ** -(at + 1.0), axis=1)
    before = np.hstack([np.zeros((n, 1)), scaled[:, :-1]]) * q**at
    ends = grid @ q ** (block - 1.0 - at)
    carried = np.concatenate([[0.0], ends[:-1]])
    scan = (before + carried[:, None] * q**at).reshape(-1)[: len(x)]
    size = np.diff(border)
    first = np.repeat(border[:-1], size)
    own = scan - scan[first] * q ** (np.arange(len(x)) - first)
    earlier = np.cumsum(x != 0) - (x != 0)
    return np.where(earlier > earlier[first], own, 0.0)  # exactly 0 where the row has no earlier term


def loss_weight(kind: str, t: Column, schedule: str = LINEAR) -> Column:
    """Weight of every token of a row: by its time, or 1. (`cart` weighs tokens.)"""
    if kind == "scheduler":
        return alpha_weight(t, schedule)
    if kind == "uniform":
        return F.lit(1.0)
    raise NotImplementedError(kind)


_CART_KIND = re.compile(r"cart(?:\[geo_p:(0\.\d+)\])?")


def with_loss_weights(df: DataFrame, kind: str, t: str = "t", masked: str = "masked", out: str = "loss_weight", schedule: str = LINEAR) -> DataFrame:
    """Add the weight of every token: `scheduler`, `uniform`, or `cart[geo_p:x]` with `cart` for x = 0.3."""
    cart = _CART_KIND.fullmatch(kind)
    if cart:
        return with_cart_weights(df, masked, out, float(cart[1] or 0.3))
    return df.withColumn(out, F.array_repeat(loss_weight(kind, F.col(t), schedule), F.size(masked)))


# ---- accounting --------------------------------------------------------------


def masked_nll(df: DataFrame, nll: str = "nll", weight: Column | None = None) -> DataFrame:
    """Per row: `nll_sum` over masked tokens, weighted, and `n_maskable` tokens."""
    w = F.lit(1.0) if weight is None else weight
    hits = F.zip_with(nll, "masked", lambda v, m: F.when(m, v).otherwise(0.0))
    total = F.aggregate(hits, F.lit(0.0), lambda a, v: a + v)
    return df.withColumn("nll_sum", total * w).withColumn(
        "n_maskable", F.size(F.filter("labels", lambda x: x != IGNORE))
    )


NORMS = ("token", "sequence", "batch")


def loss_norm(rows: DataFrame, batch: str, *kinds: str) -> DataFrame:
    """Loss per batch from `masked_nll` rows, normalised by token, sequence or batch.

    One kind gives a row per batch (batch, loss), several a row per batch and kind
    (batch, kind, loss), all from one aggregate.
    """
    if not kinds or not set(kinds) <= set(NORMS):
        raise ValueError(f"unknown normalisation in {kinds!r}")
    n = F.count(F.lit(1))
    losses = {
        "token": F.sum("nll_sum") / F.greatest(F.sum("n_maskable"), F.lit(1)),
        "sequence": F.sum(F.col("nll_sum") / F.greatest("n_maskable", F.lit(1))) / n,
        "batch": F.sum("nll_sum") / n,
    }
    if len(kinds) == 1:
        return rows.groupBy(batch).agg(losses[kinds[0]].alias("loss"))
    wide = rows.groupBy(batch).agg(*(losses[k].alias(f"_{k}") for k in kinds))
    long = F.stack(F.lit(len(kinds)), *(c for k in kinds for c in (F.lit(k), F.col(f"_{k}"))))
    return wide.select(batch, long.alias("kind", "loss"))


def nll_ppl(rows: DataFrame, value: str = "nll_sum", weight: str = "n_maskable", split: str = "split") -> DataFrame:
    """Mean NLL per token and its exponential, one row per metric and split.

    Names are bare for `train` and carry the split in front otherwise.
    """
    mean = rows.groupBy(split).agg((F.sum(value) / F.nullif(F.sum(weight), F.lit(0))).alias("nll"))
    long = mean.select(
        split, F.stack(F.lit(2), F.lit("nll"), F.col("nll"), F.lit("ppl"), F.exp("nll")).alias("metric", "value")
    )
    name = F.when(F.col(split) == "train", F.col("metric")).otherwise(F.concat_ws("_", F.col(split), F.col("metric")))
    return long.select(name.alias("name"), "value")


def mc_loglik(draws: DataFrame, key: str, total_length: str | None = None) -> DataFrame:
    """Minus the mean over draws of the masked NLL over the mask probability.

    `total_length` adds `loglik_union`, divided by prompt and target length.
    """
    loglik = -F.avg(F.col("nll_sum") / F.col("p_mask"))
    columns = [loglik.alias("loglik")]
    if total_length:
        columns.append((loglik / F.max(total_length)).alias("loglik_union"))
    return draws.groupBy(key).agg(*columns)


def completion_mask(ids: Column, eos: int, drop_truncated: bool = False) -> Column:
    """1 up to and including the first EOS, then 0; all 0 without EOS if asked for."""
    n = F.size(ids)
    at = F.array_position(ids, F.lit(eos).cast("int"))
    ones = F.when(at > 0, at).otherwise(F.lit(0) if drop_truncated else n)
    return F.concat(A.fill(1, ones), A.fill(0, n - ones))
