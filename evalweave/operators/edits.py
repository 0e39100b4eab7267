"""Aligned pairs, remaining edits and edit-rate losses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import arrays as A
from evalweave.functions.hashing import hash_uniforms, hashes, per_position, text_before

# Fixed value: the gap of an aligned pair.
BLANK = -1
DELETE, INSERT, REPLACE = "DEL", "INS", "SUB"


def align_positional(x0: Column, x1: Column) -> Column:
    """Pairs struct(z0, z1) by position, gaps at the shorter one's end."""
    return F.transform(
        F.arrays_zip(x0.alias("a"), x1.alias("b")),
        lambda z: F.struct(F.coalesce(z["a"], F.lit(BLANK)).alias("z0"), F.coalesce(z["b"], F.lit(BLANK)).alias("z1")),
    )


def kappa_mix(pairs: Column, key: Column, k: Column, seed: int = 42) -> Column:
    """Each position's target with probability k, else its source."""
    drawn = F.struct(hash_uniforms(F.size(pairs), u=(seed, "mix", key)).alias("at"), k.alias("share"))

    def mix(d: Column) -> Column:
        return F.zip_with(pairs, d["at"], lambda z, at: F.when(at["u"] < d["share"], z["z1"]).otherwise(z["z0"]))

    return A.let(drawn, mix)


def strip_blanks(z: Column) -> Column:
    return F.array_remove(z, F.lit(BLANK).cast("int"))


def remaining_edits(df: DataFrame, key: str, zt: str, z1: str) -> DataFrame:
    """Rows `key`, `j`, `kind`, `pos`, `token`: what turns zt into z1.

    `pos` counts the tokens of zt before the position; an insertion goes after
    the token before it.
    """
    return edits_by_key(df, key, zt, z1).select(key, F.inline("edits"))


def edits_by_key(df: DataFrame, key: str, zt: str, z1: str, *others: str) -> DataFrame:
    """One row per key: `members`, its pairs with their other columns, and `edits`, a list.

    A pair with a list that is NULL is a member without edits.
    Tokens stay in lists of whole pairs. The count is a running total inside one key, over
    positions and then pairs; it is made in Arrow batches.
    """
    whole = F.col(zt).isNotNull() & F.col(z1).isNotNull()
    members = F.collect_list(F.struct(F.when(whole, F.col(zt)).alias("a"), F.when(whole, F.col(z1)).alias("b"), *others))
    token = df.schema[z1].dataType.elementType.simpleString()
    found = F.arrow_udf(_edits, f"array<struct<j: int, kind: string, pos: bigint, token: {token}>>").asNondeterministic()
    rows = df.groupBy(key).agg(members.alias("members"))
    return rows.withColumn("edits", found(F.col("members")["a"], F.col("members")["b"]))


def _numbers(values: pa.Array, missing=0) -> np.ndarray:
    return values.fill_null(missing).to_numpy(zero_copy_only=False)


def _borders(sizes: pa.Array) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(_numbers(sizes)))).astype(np.int64)


def _edits(a: pa.Array, b: pa.Array) -> pa.Array:
    """The edits of rows, each a list of aligned pairs a, b."""
    a_lists, b_lists = a.flatten(), b.flatten()
    xs, ys = a_lists.flatten(), b_lists.flatten()
    lists, border, other = _borders(a.value_lengths()), _borders(a_lists.value_lengths()), _borders(b_lists.value_lengths())
    size, rows = np.diff(border), border[lists]  # rows: where the tokens of each row begin
    at_list = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(xs)) - border[at_list]
    x = _numbers(xs, BLANK)
    token = x != BLANK
    order = slice(None)
    if np.diff(lists).max(initial=0) > 1:
        order = np.lexsort((place, np.repeat(np.arange(len(a)), np.diff(rows))))  # stable: pairs in turn
    seen = np.empty(len(x), np.int64)
    seen[order] = np.cumsum(token[order]) - token[order]
    before = np.concatenate(([0], np.cumsum(token)))
    seen -= np.repeat(before[rows[:-1]], np.diff(rows))
    in_b = place < np.diff(other)[at_list]
    beside = np.where(in_b, other[at_list] + place, 0)
    y = _numbers(ys, BLANK)[beside] if len(ys) else np.full(len(x), BLANK)
    known = in_b & _numbers(xs.is_valid(), False) & (_numbers(ys.is_valid(), False)[beside] if len(ys) else False)
    at = np.flatnonzero(known & (x != y))
    inserted, deleted = ~token[at], y[at] == BLANK
    kind = pa.array([REPLACE, DELETE, INSERT]).take(pa.array(np.where(inserted, 2, np.where(deleted, 1, 0))))
    pos = np.where(inserted, np.maximum(seen[at] - 1, 0), seen[at])
    changed = ys.take(pa.array(beside[at]))
    changed = pc.if_else(pa.array(deleted & ~inserted), pa.scalar(None, changed.type), changed)
    found = pa.StructArray.from_arrays([pa.array(place[at].astype(np.int32)), kind, pa.array(pos), changed], ["j", "kind", "pos", "token"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, rows).astype(np.int32)), found)


def fire(rate: Column, tau: float, u: Column) -> Column:
    """A Bernoulli draw with probability rate * tau, kept below 1."""
    return u < F.least(F.greatest(rate * tau, F.lit(0.0)), F.lit(1.0 - 1e-6))


def decide_edits(df: DataFrame, key: str, tau: float, seed: int = 42, edit_prompt: bool = False) -> DataFrame:
    """Add `decisions` per position from `ids`, `prompt_len` and `rates`
    (array of struct del, sub, ins, sub_token, ins_token).

    A position that fires is deleted or replaced by the share of its rates. The
    prompt is protected; insertion is allowed after its last token. Positions of
    many rows are decided at once, in Arrow batches.
    """
    n = F.lit(0) if edit_prompt else F.greatest(F.least(F.col("prompt_len"), F.size("ids")), F.lit(1))
    whats = ("edit", "kind", "insert")
    of = df.schema["rates"].dataType.elementType

    def decide(columns: list[pa.Array], size: np.ndarray) -> pa.Array:
        rates, upto, *starts = columns
        r = rates.flatten()
        border = np.concatenate(([0], np.cumsum(size)))
        row = np.repeat(np.arange(len(size)), size)
        protected = _numbers(upto)[row] - (np.arange(border[-1]) - border[row])  # positions up to the prompt's end
        u = {what: hashes(start, size) / 2.0**32 for what, start in zip(whats, starts)}

        def rate(name: str, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            given = pc.struct_field(r, name)
            return np.where(free, _numbers(given.cast("double"), 0.0), 0.0), ~free | _numbers(given.is_valid(), False)

        def hit(value: np.ndarray, top: float, draw: np.ndarray) -> np.ndarray:
            return draw < np.fmin(np.maximum(value, 0.0), top)  # NaN counts as the highest

        (drop, ok_drop), (sub, ok_sub) = rate("del", protected <= 0), rate("sub", protected <= 0)
        ins, ok_ins = rate("ins", protected <= 1)
        fires = ok_drop & ok_sub & hit((drop + sub) * tau, 1.0 - 1e-6, u["edit"])
        deleted = fires & hit(drop / (drop + sub + 1e-8), 1.0, u["kind"])
        inserted = ok_ins & hit(ins * tau, 1.0 - 1e-6, u["insert"])

        def where(mask: np.ndarray, name: str) -> pa.Array:
            tokens = pc.struct_field(r, name)
            return pc.if_else(pa.array(mask), tokens, pa.scalar(None, tokens.type))

        return pa.StructArray.from_arrays(
            [pa.array(deleted), where(fires & ~deleted, "sub_token"), where(inserted, "ins_token")], ["delete", "replace", "insert"]
        )

    kinds = [of[name].dataType.simpleString() for name in ("sub_token", "ins_token")]
    call = per_position("array<struct<delete: boolean, replace: {}, insert: {}>>".format(*kinds), decide)
    return df.withColumn("decisions", call(F.size("rates"), F.col("rates"), n, *(text_before((seed, what, F.col(key))) for what in whats)))


def apply_edits(ids: Column, decisions: Column) -> Column:
    """Delete, replace and insert in one pass over the positions."""

    @F.arrow_udf("array<int>")
    def change(tokens: pa.Array, choices: pa.Array) -> pa.Array:
        x, d = tokens.flatten(), choices.flatten()
        border, other = _borders(tokens.value_lengths()), _borders(choices.value_lengths())
        slots = np.concatenate(([0], np.cumsum(2 * np.maximum(np.diff(border), np.diff(other)))))

        def slot(ends: np.ndarray) -> np.ndarray:  # a position has two: what stands there, and what follows
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            return slots[row] + 2 * (np.arange(ends[-1]) - ends[row])

        value, there = np.zeros(slots[-1], np.int32), np.zeros(slots[-1], bool)
        value[slot(border)], there[slot(border)] = _numbers(x), _numbers(x.is_valid(), False)
        at = slot(other)
        for name, shift in (("replace", 0), ("insert", 1)):
            given = pc.struct_field(d, name).cast(pa.int32())
            has = np.flatnonzero(_numbers(given.is_valid(), False))
            value[at[has] + shift], there[at[has] + shift] = _numbers(given)[has], True
        there[at[_numbers(pc.struct_field(d, "delete"), False)]] = False
        kept = np.concatenate(([0], np.cumsum(there)))[slots]
        none = pc.or_(tokens.is_null(), choices.is_null())
        return pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(value[there]), mask=none)

    return change.asNondeterministic()(ids.cast("array<int>"), decisions)


def edit_rate_loss(
    pairs: DataFrame, rates: DataFrame | str, edits: DataFrame | str, key: str, max_w: float | None = None, per_position: bool = True
) -> DataFrame:
    """Survival and edit terms of the loss per pair.

    `pairs`: key, w, x1_len, cur_len. `rates`: key, pos and the rates and token
    log-probabilities of each position. An edit beyond the current length fails.
    Logs are clamped at 1e-12 and w at max_w.

    Where rates and edits are names of columns, `pairs` has one row per key: a struct of lists, the
    rates up to the longest pair in order of positions, a list of edits, and `members`, a list
    of the pairs. Nothing is shuffled then.
    """
    w = F.least(F.col("w"), F.lit(max_w)) if max_w else F.col("w")
    denom = F.greatest(F.col("x1_len"), F.lit(1)).cast("double") if per_position else F.lit(1.0)

    if isinstance(rates, str):
        lists = [F.col(rates)[c] for c in ("del", "sub", "ins", "log_sub", "log_ins")]
        sums = F.arrow_udf(_list_sums, "struct<rate: double, edit: double>").asNondeterministic()
        both = sums(F.col("members")["cur_len"], F.col(edits)["kind"], F.col(edits)["pos"], *lists)
        return pairs.select(key, "members", both.alias("_s")).select(key, "_s", F.inline("members")).select(
            key, (w * F.col("_s.rate") / denom).alias("survival"), (w * F.col("_s.edit") / denom).alias("positive")
        )

    def safe_log(c: str) -> Column:
        return F.log(F.greatest(F.col(c), F.lit(1e-12)))

    survival = rates.groupBy(key).agg(F.sum(F.col("sub") + F.col("del") + F.col("ins")).alias("_rate"))
    term = (
        F.when(F.col("kind") == REPLACE, F.col("log_sub") + safe_log("sub"))
        .when(F.col("kind") == INSERT, F.col("log_ins") + safe_log("ins"))
        .otherwise(safe_log("del"))
    )
    inside = F.when(F.col("sub").isNotNull(), -term).otherwise(
        F.raise_error(F.lit("edit position out of range")).cast("double")
    )
    positive = edits.join(rates, [key, "pos"], "left").groupBy(key).agg(F.sum(inside).alias("_edit"))
    return (
        pairs.join(survival, key, "left")
        .join(positive, key, "left")
        .select(
            key,
            (w * F.coalesce("_rate", F.lit(0.0)) / denom).alias("survival"),
            (w * F.coalesce("_edit", F.lit(0.0)) / denom).alias("positive"),
        )
    )


def _list_sums(ends: pa.Array, kind: pa.Array, pos: pa.Array, *rates: pa.Array) -> pa.Array:
    """The sums of rates and of edit terms of rows; a position counts once for each pair that reaches it."""
    n = len(ends)
    drop, sub, ins, log_sub, log_ins = (_numbers(r.flatten(), 0.0) for r in rates)
    border = _borders(rates[0].value_lengths())
    row = np.repeat(np.arange(n), np.diff(border))
    slots = border + np.arange(n + 1)  # one more per row, where its longest pair ends
    end, owner = _numbers(ends.flatten()), np.repeat(np.arange(n), _numbers(ends.value_lengths()))
    step = np.bincount(slots[owner], minlength=slots[-1])
    step -= np.bincount(slots[owner] + np.minimum(end, np.diff(border)[owner]), minlength=slots[-1])
    reach = np.cumsum(step)
    total = np.bincount(row, (sub + drop + ins) * reach[np.arange(border[-1]) + row], n)

    edited = np.repeat(np.arange(n), _numbers(pos.value_lengths()))
    at = _numbers(pos.flatten())
    if ((at < 0) | (at >= np.diff(border)[edited])).any() or (reach[slots[edited] + at] == 0).any():
        raise ValueError("edit position out of range")
    place = border[edited] + at
    kinds = kind.flatten()
    replaced, inserted = (_numbers(pc.equal(kinds, k), False) for k in (REPLACE, INSERT))

    def term(rate: np.ndarray, log: np.ndarray | float) -> np.ndarray:
        return log + np.log(np.maximum(rate[place], 1e-12))

    terms = np.where(replaced, term(sub, log_sub[place]), np.where(inserted, term(ins, log_ins[place]), term(drop, 0.0)))
    return pa.StructArray.from_arrays([pa.array(total), pa.array(np.bincount(edited, -terms * reach[slots[edited] + at], n))], ["rate", "edit"])


def mean_edit_loss(terms: DataFrame) -> DataFrame:
    return terms.agg(
        F.avg("survival").alias("loss_surv"),
        F.avg("positive").alias("loss_pos"),
        (F.avg("survival") + F.avg("positive")).alias("loss"),
    )
