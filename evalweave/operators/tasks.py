"""The known tasks: how their prompts are made and which rewards they have."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.operators import project as P
from evalweave.operators import rewards as R

# A reward adds one column named after it to rows with `completion` and task fields.
Reward = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Task:
    prompts: Callable[[DataFrame], DataFrame]
    rewards: dict[str, Reward]


def _column(name: str, fn) -> Reward:
    return lambda df: df.withColumn(name, fn())


C = "completion"
XMLCOUNT = _column("xmlcount", lambda: R.xmlcount(F.col(C)))
SOFT = _column("soft_format", lambda: R.soft_format(F.col(C)))
STRICT = _column("strict_format", lambda: R.strict_format(F.col(C)))
INT = _column("int", lambda: R.is_int(F.col(C)))
EXACT = _column("correctness", lambda: R.exact(F.col(C), F.col("answer")))
BOXED = _column("boxed_tags", lambda: R.boxed_tags(F.col(C)))

TASKS = {
    "gsm8k": Task(
        P.prompt_gsm8k,
        {"xmlcount": XMLCOUNT, "soft_format": SOFT, "strict_format": STRICT, "int": INT, "correctness": EXACT},
    ),
    "countdown": Task(P.prompt_countdown, {"countdown": lambda df: R.with_countdown_reward(df, C, "numbers", "target", "countdown")}),
    "sudoku": Task(P.prompt_sudoku, {"sudoku": lambda df: R.with_sudoku_reward(df, C, "puzzle", "solution", "sudoku")}),
    "math": Task(
        P.prompt_math, {"math": lambda df: R.with_math_reward(df, C, "answer", "math"), "boxed_tags": BOXED}
    ),
    "code": Task(P.prompt_code, {"xmlcount": XMLCOUNT, "code": lambda df: _no_results()}),
}


def _no_results():
    raise ValueError("the code reward needs the table of unit-test outcomes: task('code', results)")


def task(name: str, results: DataFrame | None = None, key: str = "doc_id") -> Task:
    """A task by name. The code reward needs the table of unit-test outcomes; scoring without it fails."""
    if name not in TASKS:
        raise ValueError(f"unknown task {name!r}; known: {', '.join(TASKS)}")
    found = TASKS[name]
    if name != "code" or results is None:
        return found

    def code(df: DataFrame) -> DataFrame:
        return R.code_reward(R.prepare_code(df, C, "tests"), results, key, "code")

    return Task(found.prompts, {**found.rewards, "code": code})


def score(df: DataFrame, rewards: dict[str, Reward]) -> DataFrame:
    """Add one column per reward."""
    for add in rewards.values():
        df = df.transform(add)
    return df


def long_rewards(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row per rollout and reward: keys, func, reward."""
    return df.unpivot(keys, names, "func", "reward")


def join_ground_truth(rollouts: DataFrame, tasks: DataFrame, on: str) -> DataFrame:
    """Rollouts beside their task's fields. No hint: Spark broadcasts the tasks
    when they are small and shuffles by key (splitting hot ones) when not.
    """
    return rollouts.join(tasks, on)
