"""Projections of source rows to prompts and chat messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions import text as T
from evalweave.functions.ordering import prefix_totals

# The prompt texts.
PROOF_PROMPT = """Complete the following Lean 4 code:

```lean4
{}
```

Before producing the Lean 4 code to formally prove the given theorem, provide a detailed proof plan outlining the main proof steps and strategies.
The plan should highlight key ideas, intermediate lemmas, and proof structures that will guide the construction of the final formal proof."""
SYSTEM_PROMPT = """
Respond in the following format:
<reasoning>
...
</reasoning>
<answer>
...
</answer>
"""
SUDOKU_PROMPT = """
Please solve the following 4x4 Sudoku puzzle. The puzzle is provided as a 16-character string reading left-to-right, top-to-bottom, where '0' represents empty cells.

Rules:
- Fill empty cells with digits 1-4
- Each row must contain digits 1-4 exactly once
- Each column must contain digits 1-4 exactly once
- Each 2x2 box must contain digits 1-4 exactly once

Important: Your solution must be a COMPLETE 16-character string with only the digits 1-4, representing your final solved grid.

Respond in this exact format:
<reasoning>
Your step-by-step solving process
</reasoning>
<answer>
[16-character solution string with no spaces or separators]
</answer>
"""
COUNTDOWN_PROMPT = (
    SYSTEM_PROMPT + "\nUsing only the numbers {}, create an arithmetic expression that evaluates to exactly {}. "
    "You must use all numbers from the list, and each number must be used exactly once. You may use the "
    "operations +, -, *, and / as needed. After reasoning, provide only your final expression inside "
    "<answer></answer> tags without including an equals sign or the target number. For example, if the "
    "numbers are [2, 3, 4] and the target is 5, a valid answer is: <answer>\n2*4-3\n</answer>"
)
MATH_PROMPT = (
    SYSTEM_PROMPT + "\n\nYou are a math expert. You will be given a question to solve. Solve it step by step. "
    "Wrap the final answer in a \\boxed{}. \n\n"
)
CODE_PROMPT = (
    SYSTEM_PROMPT + "\n\nYou are a coding expert. You will be given a coding problem to solve. "
    "Solve it step by step. \n\n"
)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_prompt(content: Column) -> Column:
    return F.array(message("user", content))


def row_index(df: DataFrame, key: str, out: str = "dataset_index") -> DataFrame:
    """Dense 0-based position in key order; the name must be free."""
    if out in df.columns:
        raise ValueError(f"column {out!r} is reserved for the row position")
    return prefix_totals(df, key, out)


def proof_prompt(statement: Column) -> Column:
    before, after = PROOF_PROMPT.split("{}")
    return F.concat(F.lit(before), T.strip(T.text_or_empty(statement)), F.lit(after))


def messages_instruct(instruction: Column, given: Column, output: Column) -> Column:
    """Instruction with optional input, and the output, all stripped."""
    ask, extra = T.strip(T.text_or_empty(instruction)), T.strip(T.text_or_empty(given))
    asked = F.when(extra != "", F.concat(ask, F.lit("\n\n"), extra)).otherwise(ask)
    return F.array(message("user", asked), message("assistant", T.strip(T.text_or_empty(output))))


def messages_pair(instruction: Column, output: Column) -> Column:
    return F.array(message("user", instruction), message("assistant", output))


def messages_reasoning(question: Column, trajectories: Column, attempt: Column) -> Column:
    """Question and answer, with the first trajectory as the reasoning."""
    none = F.lit(None).cast("string")
    return F.array(
        F.struct(F.lit("user").alias("role"), none.alias("reasoning_content"), question.alias("content")),
        F.struct(
            F.lit("assistant").alias("role"),
            F.get(trajectories, 0).alias("reasoning_content"),
            attempt.alias("content"),
        ),
    )


def first_turn(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """First user text and the first assistant text after it, from one row per turn.

    A conversation where either is missing or blank is dropped; no later turn
    is tried. One aggregation by conversation, with partial results per task.
    """
    known = turns.filter(F.col("text").isNotNull())
    user = F.col("role") == "user"
    # First user turn per conversation, then the first assistant turn behind it.
    asks = known.filter(user).groupBy(key).agg(
        F.min("turn").alias("_turn"), F.min_by("text", "turn").alias("prompt")
    )
    answers = (
        known.filter(F.col("role") == "assistant")
        .join(asks, key)
        .filter(F.col("turn") > F.col("_turn"))
        .groupBy(key)
        .agg(F.any_value("prompt").alias("prompt"), F.min_by("text", "turn").alias("response"))
    )
    return (
        answers.withColumn("prompt", T.strip("prompt"))
        .withColumn("response", T.strip("response"))
        .filter((F.col("prompt") != "") & (F.col("response") != ""))
    )


def first_turn_nested(messages: Column) -> Column:
    """The same on a `messages` array: struct(prompt, response) or NULL."""
    texts = F.filter(messages, lambda m: m["content"].isNotNull())
    from_user = F.slice(
        texts, F.greatest(F.array_position(F.transform(texts, lambda m: m["role"]), F.lit("user")), F.lit(1)).cast("int"), F.size(texts)
    )
    ask = F.get(F.filter(texts, lambda m: m["role"] == "user"), 0)["content"]
    answer = F.get(F.filter(from_user, lambda m: m["role"] == "assistant"), 0)["content"]
    ok = ask.isNotNull() & (T.strip(ask) != "") & (T.strip(answer) != "")
    return F.when(ok, F.struct(T.strip(ask).alias("prompt"), T.strip(answer).alias("response")))


def rename_splits(df: DataFrame, names: dict[str, str], split: str = "split") -> DataFrame:
    """Rename splits; rows of splits that are not named are dropped."""
    out = F.lit(None).cast("string")
    for old, new in names.items():
        out = F.when(F.col(split) == old, F.lit(new)).otherwise(out)
    return df.filter(F.col(split).isin(list(names))).withColumn(split, out)


def hash_answer(answer: Column) -> Column:
    """Text between the first and the next `####`, stripped; NULL without one."""
    return F.when(T.has(answer, "####"), T.strip(F.split_part(answer, F.lit("####"), F.lit(2))))


def prompt_gsm8k(df: DataFrame) -> DataFrame:
    content = F.concat(F.lit(SYSTEM_PROMPT + "\n\n"), F.col("question"))
    return df.withColumn("prompt", user_prompt(content)).withColumn("answer", hash_answer(F.col("answer")))


def prompt_countdown(df: DataFrame) -> DataFrame:
    """Tasks with three numbers; the list is printed as `[1, 2, 3]`."""
    start, middle, end = COUNTDOWN_PROMPT.split("{}")
    nums = F.concat(F.lit("["), F.array_join(F.col("nums").cast("array<string>"), ", "), F.lit("]"))
    content = F.concat(F.lit(start), nums, F.lit(middle), F.col("target").cast("string"), F.lit(end))
    kept = df.filter(F.size("nums") == 3)
    return kept.withColumn("prompt", user_prompt(content)).withColumn("numbers", F.col("nums"))


def prompt_sudoku(df: DataFrame) -> DataFrame:
    content = F.concat(
        F.lit(SUDOKU_PROMPT + "\n\nSolve the following Sudoku puzzle: "), F.col("Puzzle"), F.lit("\n")
    )
    return df.withColumn("prompt", user_prompt(content)).withColumnsRenamed({"Puzzle": "puzzle", "Solution": "solution"})


def prompt_math(df: DataFrame) -> DataFrame:
    content = F.concat(F.lit(MATH_PROMPT), F.col("problem"))
    return df.withColumn("prompt", user_prompt(content)).withColumn("answer", F.col("solution"))


def prompt_code(df: DataFrame) -> DataFrame:
    content = F.concat(F.lit(CODE_PROMPT), F.col("question"))
    answer = F.struct(F.col("solution").alias("solution"), F.col("test").alias("tests"))
    return df.withColumn("prompt", user_prompt(content)).withColumn("answer", answer)


def _header_turn(m: Column) -> Column:
    return F.concat(
        F.lit("<|start_header_id|>"), m["role"], F.lit("<|end_header_id|>\n\n"), T.strip(m["content"]), F.lit("<|eot_id|>")
    )


def render_header(messages: Column, add_generation_prompt: bool = False, bos: str = "") -> Column:
    """Chat text with a header per message; `bos` goes in front once."""
    turns = F.array_join(F.transform(messages, _header_turn), "")
    start = F.when(F.size(messages) > 0, F.lit(bos)).otherwise(F.lit(""))
    opening = "<|start_header_id|>assistant<|end_header_id|>\n\n"
    return F.concat(start, turns, _opening(messages, opening, add_generation_prompt))


def render_sections(messages: Column, add_generation_prompt: bool = False) -> Column:
    """Chat text in [SYS] / [Question] / [Answer] sections.

    Only a leading system message has a section; other roles are dropped.
    """

    def section(tag: str, m: Column) -> Column:
        return F.concat(F.lit(f"[{tag}]\n"), T.strip(m["content"]), F.lit(f"\n[/{tag}]\n\n"))

    def turn(m: Column, i: Column) -> Column:
        return (
            F.when((m["role"] == "system") & (i == 0), section("SYS", m))
            .when(m["role"] == "user", section("Question", m))
            .when(m["role"] == "assistant", section("Answer", m))
            .otherwise("")
        )

    return F.concat(F.array_join(F.transform(messages, turn), ""), _opening(messages, "[Answer]\n", add_generation_prompt))


def _opening(messages: Column, text: str, wanted: bool) -> Column:
    """The assistant's opening, unless the last message is the assistant's."""
    if not wanted:
        return F.lit("")
    last = F.try_element_at(messages, F.lit(-1))["role"]
    return F.when(F.coalesce(last != "assistant", F.lit(True)), F.lit(text)).otherwise("")


def messages_of(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation with its ordered `messages` array."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    packed = turns.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("m"))
    return packed.select(
        key,
        F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"),
    )


def keep_columns(df: DataFrame, keep: set[str]) -> DataFrame:
    """Only the named columns that exist, in table order."""
    return df.select(*[c for c in df.columns if c in keep])


PREPARED_COLUMNS = {"input_ids", "labels"}
PREPARED_CHAT_COLUMNS = {"input_ids", "labels", "prompt_len", "attention_mask"}

MapFn = Callable[[DataFrame], DataFrame]
