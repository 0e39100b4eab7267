"""Filters, limits, splits and shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import text as T
from evalweave.functions.ordering import head_rows, nth_keys, prefix_totals, up_to


def named_split(df: DataFrame, wanted: str, splits: list[str] | None = None) -> DataFrame:
    """Rows of a split. A source without that split is its `train` rows, cut down
    by a logical `split` column where it has one.
    """
    if splits is not None and wanted in splits:
        return df.filter(F.col("hf_split") == wanted).drop("hf_split")
    rows = df.filter(F.col("hf_split") == "train").drop("hf_split") if splits is not None else df
    if wanted != "train" and "split" in rows.columns:
        rows = rows.filter(F.col("split") == wanted)
    return rows


def assistant_mentions(df: DataFrame, word: str) -> DataFrame:
    """Rows whose second message contains the word (case matters)."""
    return df.filter(T.has(F.get("messages", 1)["content"], word))


# Which language column each configuration has.
LANGUAGE_COLUMN = {
    "synthetic_code_snippet": "lang",
    "algorithmic_corpus": "lang",
    "synthetic_qa": "program_lang",
}


def in_language(df: DataFrame, config: str, lang: str | None) -> DataFrame:
    """Rows of one configuration in a language; other configurations have none to test."""
    if not lang:
        return df
    if config not in LANGUAGE_COLUMN:
        raise NotImplementedError(f"no language column is known for {config!r}")
    return df.filter(F.col(LANGUAGE_COLUMN[config]) == lang)


def _wants(n: int):
    return lambda total: n


def limit_split(df: DataFrame, limits: dict[str, int], key: str, splits: list[str]) -> DataFrame:
    """The first rows of each limited split, in key order.

    `splits` are the splits of the source. With one split and several limits
    each target is a head of the same rows, so they overlap; a row then appears
    once for each target it is in. The cuts of all limits are found in one pass
    over the keys, the rows are read once and filtered in place.
    """
    if not limits:
        return df
    if len(splits) == 1:
        last = nth_keys(df, key, {t: (None, _wants(n)) for t, n in limits.items()})
        targets = F.array_compact(F.array(*[F.when(up_to(F.col(key), last[t]), F.lit(t)) for t in limits]))
        return df.withColumn("split", F.explode(targets))
    limited = {s: n for s, n in limits.items() if s in splits}
    last = nth_keys(df, key, {s: (F.col("split") == s, _wants(n)) for s, n in limited.items()}) if limited else {}
    kept = F.lit(True)  # rows without a split have no limit
    for s in limited:
        kept = F.when(F.col("split") == s, up_to(F.col(key), last[s])).otherwise(kept)
    return df.filter(kept)


def limit_split_stream(df: DataFrame, limits: dict[str, int], key: str, splits: list[str]) -> DataFrame:
    """Limits as an ordered reader takes them: only train and test, kept apart.

    From one split, test is the first rows and train the next ones.
    """
    train, test = limits.get("train"), limits.get("test")
    if train is None and test is None:
        return df
    asked = {k: v for k, v in (("train", train), ("test", test)) if v is not None}
    if len(splits) > 1:
        missing = [s for s in asked if s not in splits]
        if missing:
            raise ValueError(f"missing split {missing} for a limit")
        return limit_split(df.filter(F.col("split").isin(list(asked))), asked, key, list(splits))
    if len(asked) == 1:
        ((name, n),) = asked.items()
        return head_rows(df, key, _wants(n)).withColumn("split", F.lit(name))
    last = nth_keys(df, key, {"test": (None, _wants(test)), "both": (None, _wants(train + test))})
    both = df.filter(up_to(F.col(key), last["both"]))
    return both.withColumn("split", F.when(up_to(F.col(key), last["test"]), "test").otherwise("train"))


def split_fraction(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Add a reproducible `split`: exactly ceil(fraction * n) rows are `test`.

    Rows are ranked by a hash of seed and key; the table is split in place by
    comparing with the last hash of the test rows.
    """
    order = F.concat_ws("|", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key).cast("string"))
    keys = df.select(order.alias("_order")).withColumn("_lead", F.conv(F.substring("_order", 1, 15), 16, 10).cast("bigint"))
    last = nth_keys(keys, "_lead", {"test": (None, lambda n: math.ceil(fraction * n))}, F.col("_order"))["test"]
    return df.withColumn("split", F.when(up_to(order, last), "test").otherwise("train"))


def select_prefix(
    df: DataFrame, key: str, half: bool = False, quarter: bool = False, max_examples: int | None = None
) -> DataFrame:
    """The first half, quarter or max_examples rows, whichever is least."""

    def want(total: int) -> int:
        caps = [total, *([total // 2] if half else []), *([total // 4] if quarter else [])]
        return min(caps if max_examples is None else [*caps, max_examples])

    return head_rows(df, key, want)


def with_shards(df: DataFrame, key: str, num_shards: int, out: str = "shard_index") -> DataFrame:
    """Add the 1-based contiguous shard of each row: shard i holds rows
    [n*(i-1) // k, n*i // k).
    """
    if num_shards < 1:
        raise ValueError(f"the number of shards must be >= 1, got {num_shards}")
    total = max(df.count(), 1)
    shard = F.expr(f"((_pos + 1) * {int(num_shards)} - 1) div {total} + 1")
    return prefix_totals(df, key, "_pos").withColumn(out, shard.cast("bigint")).drop("_pos")


def shard(df: DataFrame, key: str, num_shards: int, shard_index: int) -> DataFrame:
    if not 1 <= shard_index <= num_shards:
        raise ValueError(f"the shard must be in [1, {num_shards}], got {shard_index}")
    return with_shards(df, key, num_shards, "_shard").filter(F.col("_shard") == shard_index).drop("_shard")


def assign_round_robin(pending: DataFrame, key: str, world: int, out: str = "rank") -> DataFrame:
    """Rank of each pending row, dealt out one by one in key order."""
    return prefix_totals(pending, key, "_pos").withColumn(out, (F.col("_pos") % world).cast("bigint")).drop("_pos")


def resume_pending(problems: DataFrame, done: DataFrame, key: str = "dataset_index") -> DataFrame:
    """Problems without a complete record."""
    return problems.join(done.select(key), key, "left_anti")


def resume_pending_ranks(problems: DataFrame, done: DataFrame, done_by_rank: DataFrame, world: int, key: str = "dataset_index") -> DataFrame:
    """Pending problems with their rank; a rank's own complete records drop out
    after the ranks are dealt out.
    """
    dealt = assign_round_robin(resume_pending(problems, done, key), key, world)
    return dealt.join(done_by_rank.select("rank", key), ["rank", key], "left_anti")


def max_tokens(df: DataFrame, max_length: int) -> DataFrame:
    return df.filter(F.size("input_ids") <= max_length)


def prompt_fits(df: DataFrame, max_length: int) -> DataFrame:
    """Drop rows whose prompt is longer than allowed (or unknown), if prompts are known."""
    if "prompt_len" not in df.columns:
        return df
    return df.filter(F.col("prompt_len") <= max_length)
