"""Aggregates over rollouts and generation metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- rollouts ------------------------------------------------------------------


def reward_total(rewards: DataFrame, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum over the reward functions of a rollout; missing ones are left out."""
    w = F.lit(1.0)
    for name, value in (weights or {}).items():
        w = F.when(F.col("func") == name, F.lit(value)).otherwise(w)
    return rewards.groupBy(*keys).agg(F.coalesce(F.sum(F.col("reward") * w), F.lit(0.0)).alias("reward"))


def _group_stats(rewards: DataFrame, group: str) -> DataFrame:
    return rewards.groupBy(group).agg(F.avg("reward").alias("group_mean"), F.stddev_samp("reward").alias("group_std"))


def group_advantage(rewards: DataFrame, group: str, scale: bool = False) -> DataFrame:
    """Reward less the group's mean, over its deviation if asked for.

    Means come from an aggregation with partial results and a join, so a group
    that holds much of the table is never sorted or buffered in one task.
    """
    advantage = F.col("reward") - F.col("group_mean")
    if scale:
        advantage = advantage / (F.col("group_std") + 1e-4)
    return rewards.join(_group_stats(rewards, group), group).withColumn("advantage", advantage)


def zero_std_share(rewards: DataFrame, group: str) -> DataFrame:
    """Share of groups whose rewards are all about equal."""
    flat = F.abs("group_std") <= 1e-8
    return _group_stats(rewards, group).agg(F.avg(F.when(flat, 1.0).otherwise(0.0)).alias("frac_reward_zero_std"))


def reward_stats(rewards: DataFrame) -> DataFrame:
    """Mean and deviation per reward function, missing ones left out."""
    return rewards.groupBy("func").agg(F.avg("reward").alias("mean"), F.stddev_samp("reward").alias("std"))


def reward_overall(totals: DataFrame, group: str) -> DataFrame:
    """Mean of the group means and of the group deviations."""
    return _group_stats(totals, group).agg(F.avg("group_mean").alias("reward"), F.avg("group_std").alias("reward_std"))


def length_stats(df: DataFrame, length: str, ended: str) -> DataFrame:
    """Mean, least and greatest length, of all and of the ended completions (0 if none)."""
    n = F.col(length).cast("double")
    done = F.when(F.col(ended), n)
    zero = F.lit(0.0)
    return df.agg(
        F.avg(n).alias("mean_length"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
        F.coalesce(F.avg(done), zero).alias("mean_terminated"),
        F.coalesce(F.min(done), zero).alias("min_terminated"),
        F.coalesce(F.max(done), zero).alias("max_terminated"),
        (1 - F.count_if(F.col(ended)) / F.count(F.lit(1))).alias("clipped_ratio"),
    )


# ---- generation ----------------------------------------------------------------

# The counters of a generation run, in the order of its records.
COUNTERS = (
    "wall_seconds", "sample_batches", "samples", "instances", "prompt_tokens", "output_tokens", "canvas_tokens",
    "max_new_tokens_budget", "model_forward_calls", "prefix_forward_calls", "denoise_forward_calls",
    "other_forward_calls", "forward_query_tokens", "forward_kv_tokens", "prefix_query_tokens",
    "denoise_query_tokens", "estimated_transformer_flops", "estimated_lm_head_flops", "estimated_total_flops",
)


@dataclass(frozen=True)
class ModelDims:
    hidden_size: int = 0
    intermediate_size: int = 0
    num_hidden_layers: int = 0
    num_attention_heads: int = 0
    num_key_value_heads: int = 0
    vocab_size: int = 0


def forward_flops(df: DataFrame, dims: ModelDims) -> DataFrame:
    """Add the estimated FLOPs of each forward call.

    Query and output projections use the hidden size, key and value the size of
    the key-value heads. Without model sizes everything is 0.
    """
    d = dims
    if not (d.hidden_size and d.intermediate_size and d.num_hidden_layers and d.num_attention_heads):
        transformer = head = F.lit(0.0)
    else:
        kv_size = (d.num_key_value_heads or d.num_attention_heads) * (d.hidden_size // d.num_attention_heads)
        tokens = F.col("batch_size").cast("double") * F.col("query_len")
        projections = 4.0 * d.hidden_size * (d.hidden_size + kv_size) * tokens
        attention = 4.0 * d.hidden_size * tokens * F.col("kv_len")
        mlp = 6.0 * d.hidden_size * d.intermediate_size * tokens
        transformer = d.num_hidden_layers * (projections + attention + mlp)
        head = 2.0 * d.hidden_size * d.vocab_size * tokens
    return df.withColumns(
        {"transformer_flops": transformer, "lm_head_flops": head}
    ).withColumn("total_flops", F.col("transformer_flops") + F.col("lm_head_flops"))


def forward_category(has_past: Column, use_cache: Column) -> Column:
    return F.when(has_past, "denoise").when(use_cache, "prefix").otherwise("other")


def forward_counters(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of the forward calls of each group."""
    kind = F.col("category")
    queries = F.col("batch_size") * F.col("query_len")
    return (
        calls.withColumn("category", forward_category(F.col("has_past"), F.col("use_cache")))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("model_forward_calls"),
            *[F.count_if(kind == k).alias(f"{k}_forward_calls") for k in ("prefix", "denoise", "other")],
            F.sum(queries).alias("forward_query_tokens"),
            F.sum(F.col("batch_size") * F.col("kv_len")).alias("forward_kv_tokens"),
            *[F.coalesce(F.sum(F.when(kind == k, queries)), F.lit(0)).alias(f"{k}_query_tokens") for k in ("prefix", "denoise")],
            F.sum("transformer_flops").alias("estimated_transformer_flops"),
            F.sum("lm_head_flops").alias("estimated_lm_head_flops"),
            F.sum("total_flops").alias("estimated_total_flops"),
        )
    )


def sum_counters(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum all counters that exist from one level to the next."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS if c in df.columns]
    return df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)


def rollup_counters(df: DataFrame, *levels: str) -> DataFrame:
    """All counters at every level at once, the run total with NULL keys."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS if c in df.columns]
    return df.rollup(*levels).agg(*sums)


def with_ratios(df: DataFrame, cfg_scale: float = 0.0) -> DataFrame:
    """Add derived rates, NULL where there is nothing to divide by.

    Guidance runs every step twice, so its calls count half.
    """
    calls = 2 if cfg_scale > 0 else 1

    def per(n: Column, d: Column) -> Column:
        return F.when(d > 0, n / d)

    c = F.col
    wall, out, canvas, steps = c("wall_seconds"), c("output_tokens"), c("canvas_tokens"), c("observed_diffusion_steps")
    total, inner = c("estimated_total_flops"), c("estimated_transformer_flops")
    return (
        df.withColumn("cfg_forward_multiplier", F.lit(calls))
        .withColumn("observed_diffusion_steps", c("denoise_forward_calls") / calls)
        .withColumn("observed_prefix_blocks", c("prefix_forward_calls") / calls)
        .withColumns(
            {
                "output_tokens_per_second": per(out, wall),
                "canvas_tokens_per_second": per(canvas, wall),
                "samples_per_second": per(c("samples"), wall),
                "instances_per_second": per(c("instances"), wall),
                "output_tokens_per_diffusion_step": per(out, steps),
                "canvas_tokens_per_diffusion_step": per(canvas, steps),
                "forward_query_tokens_per_second": per(c("forward_query_tokens"), wall),
                "estimated_total_tflops_per_second": per(total / 1e12, wall),
                "estimated_transformer_tflops_per_second": per(inner / 1e12, wall),
                "estimated_total_flops_per_output_token": per(total, out),
                "estimated_total_flops_per_canvas_token": per(total, canvas),
                "estimated_total_flops_per_instance": per(total, c("instances")),
            }
        )
    )


RATIOS = (
    "output_tokens_per_second", "canvas_tokens_per_second", "samples_per_second", "instances_per_second",
    "output_tokens_per_diffusion_step", "canvas_tokens_per_diffusion_step", "forward_query_tokens_per_second",
    "estimated_total_tflops_per_second", "estimated_transformer_tflops_per_second",
    "estimated_total_flops_per_output_token", "estimated_total_flops_per_canvas_token", "estimated_total_flops_per_instance",
)


def metrics_summary(records: DataFrame, cfg_scale: float = 0.0, metrics: str = "generation_metrics") -> DataFrame:
    """Run totals and rates over the records that carry metrics."""
    rows = records.filter(F.col(metrics).isNotNull()).select(f"{metrics}.*", F.lit(1).alias("_one"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS if c in rows.columns]
    return with_ratios(rows.agg(*sums, F.count("_one").alias("records_with_metrics")), cfg_scale)


def block_plan(max_new_tokens: Column, steps: Column, block_size: Column, explicit: Column) -> Column:
    """struct(num_blocks, steps_per_block): steps spread over blocks unless given."""
    blocks = F.ceil(max_new_tokens / block_size)
    return F.struct(blocks.alias("num_blocks"), F.coalesce(explicit, F.ceil(steps / blocks)).alias("steps_per_block"))


def run_summary(merged: DataFrame, resumed: DataFrame, num_samples: int, settings: dict, cfg_scale: float = 0.0) -> DataFrame:
    """One row: counts of the run beside its settings, and the summary of the metrics the records carry."""
    counts = merged.agg(F.count(F.lit(1)).alias("num_examples")).withColumn(
        "num_resumed_examples", resumed.agg(F.count(F.lit(1))).scalar()
    )
    new = F.greatest(F.col("num_examples") - F.col("num_resumed_examples"), F.lit(0))
    if "generation_metrics" in merged.columns:
        counts = counts.withColumn("generation_metrics", metrics_summary(merged, cfg_scale).select(F.struct("*")).scalar())
    return counts.withColumn("num_new_examples", new).withColumns(
        {
            "num_samples_per_example": F.lit(num_samples).cast("bigint"),
            "total_generations": F.col("num_examples") * num_samples,
            "new_generations": F.col("num_new_examples") * num_samples,
            **{k: F.lit(v) for k, v in settings.items()},
        }
    )
