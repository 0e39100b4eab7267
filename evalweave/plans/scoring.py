"""Queries on rewards, rollout statistics and generation metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from evalweave.operators import merge as G
from evalweave.operators import metrics as M
from evalweave.operators import rewards as R
from evalweave.operators import tasks as TK
from evalweave.plans import duck as D
from evalweave.plans import inputs as I
from evalweave.plans.registry import ORACLE, query
from evalweave.plans.verification import VERDICT_CTES
from evalweave.sources import readers as RD
from evalweave.sources import sinks as W
from evalweave.sources.scratch import scratch_dir

ROLL = {"r": I.ROLLOUTS}


def _roll(spark, sf):
    return I.rollouts(spark, sf)


def _score_of(fn):
    return lambda spark, sf: _roll(spark, sf).select("doc_id", fn().alias("reward"))


def c():
    return F.col("completion")


# ---- format ---------------------------------------------------------------------

_XML = D.strip(D.before_first(f"({D.after_last('completion', '<answer>')})", "</answer>"))
_XMLCOUNT = f"""(CASE WHEN {D.count_of('completion', '<reasoning>' + chr(10))} = 1 THEN 0.125::DOUBLE ELSE 0 END
  + CASE WHEN {D.count_of('completion', chr(10) + '</reasoning>' + chr(10))} = 1 THEN 0.125::DOUBLE ELSE 0 END
  + CASE WHEN {D.count_of('completion', chr(10) + '<answer>' + chr(10))} = 1 THEN 0.125::DOUBLE - length({D.after_last('completion', chr(10) + '</answer>' + chr(10))}) * 0.001::DOUBLE ELSE 0 END
  + CASE WHEN {D.count_of('completion', chr(10) + '</answer>')} = 1 THEN 0.125::DOUBLE - (length({D.after_last('completion', chr(10) + '</answer>')}) - 1) * 0.001::DOUBLE ELSE 0 END)"""
_STRICT = "CASE WHEN regexp_matches(completion, '(?s)\\A<reasoning>\\n.*?\\n</reasoning>\\n<answer>\\n.*?\\n</answer>\\n\\n?\\z') THEN 0.5::DOUBLE ELSE 0 END"
_SOFT = f"CASE WHEN regexp_matches(completion, '(?s)\\A<reasoning>.*?</reasoning>[{D.WS_CLASS}]*<answer>.*?</answer>') THEN 0.5::DOUBLE ELSE 0 END"
_INT = f"CASE WHEN regexp_matches({_XML}, '\\A[0-9]+\\z') THEN 0.5::DOUBLE ELSE 0 END"


def _reward_sql(expr: str) -> str:
    return D.ctes(**ROLL) + f"SELECT doc_id, {expr} AS reward FROM r"


@query("xml_answer", D.ctes(**ROLL) + f"SELECT doc_id, {_XML} AS answer FROM r")
def xml_answer(spark, sf):
    return _roll(spark, sf).select("doc_id", R.xml_answer(c()).alias("answer"))


@query("reward_xmlcount", _reward_sql(f"round({_XMLCOUNT}, 6)"))
def reward_xmlcount(spark, sf):
    return _roll(spark, sf).select("doc_id", F.round(R.xmlcount(c()), 6).alias("reward"))


query("reward_strict_format", _reward_sql(_STRICT))(_score_of(lambda: R.strict_format(c())))
query("reward_soft_format", _reward_sql(_SOFT))(_score_of(lambda: R.soft_format(c())))
query("reward_len", _reward_sql("CAST(-length(completion) AS INT)"))(_score_of(lambda: R.length_reward(c())))
query("reward_int", _reward_sql(_INT))(_score_of(lambda: R.is_int(c())))


@query("reward_exact", _reward_sql(f"CASE WHEN {_XML} = truth THEN 2.0::DOUBLE ELSE 0 END"))
def reward_exact(spark, sf):
    return _roll(spark, sf).select("doc_id", R.exact(c(), F.col("truth")).alias("reward"))


@query(
    "join_ground_truth",
    D.ctes(**ROLL, problems=I.PROBLEMS) + f"SELECT doc_id, name, CASE WHEN {_XML} = CAST(dataset_index % 5 AS VARCHAR) THEN 2.0::DOUBLE ELSE 0 END AS reward FROM r JOIN problems ON group_id = dataset_index",
)
def join_ground_truth(spark, sf):
    tasks = I.problems(spark, sf).select(F.col("dataset_index").alias("group_id"), "name", (F.col("dataset_index") % 5).cast("string").alias("answer"))
    joined = TK.join_ground_truth(_roll(spark, sf), tasks, "group_id")
    return joined.select("doc_id", "name", R.exact(c(), F.col("answer")).alias("reward"))


# ---- boxed answers ----------------------------------------------------------------

# Braces never nest more than twice in the rollouts, which is what the check needs.
_BOX = f"""CASE WHEN contains(completion, '\\boxed ') THEN concat('\\boxed ', {D.before_first("(" + D.after_last('completion', '\\boxed ') + ")", '$')})
  WHEN contains(completion, '\\boxed') THEN nullif(regexp_extract(concat('\\boxed', {D.after_last('completion', '\\boxed')}), '(?s)\\A[^{{}}]*\\{{([^{{}}]*(\\{{[^{{}}]*\\}}))*[^{{}}]*\\}}'), '')
  WHEN contains(completion, '\\fbox') THEN nullif(regexp_extract(concat('\\fbox', {D.after_last('completion', '\\fbox')}), '(?s)\\A[^{{}}]*\\{{([^{{}}]*(\\{{[^{{}}]*\\}}))*[^{{}}]*\\}}'), '')
  ELSE completion END"""
_UNBOX = "CASE WHEN starts_with(box, '\\boxed ') THEN substr(box, 8) WHEN starts_with(box, '\\boxed{') AND ends_with(box, '}') THEN substr(box, 8, length(box) - 8) ELSE box END"
BOX = {**ROLL, "b": f"SELECT *, {_BOX} AS box FROM r", "u": f"SELECT *, {_UNBOX} AS inner_text FROM b"}


@query("boxed_last", D.ctes(**BOX) + "SELECT doc_id, box, inner_text FROM u")
def boxed_last(spark, sf):
    return _roll(spark, sf).withColumn("box", R.boxed_last(c())).select("doc_id", "box", R.unboxed(F.col("box")).alias("inner_text"))


# Answers in many spellings of a few values, and some with no normal form.
_ANSWERS = """SELECT doc_id, CASE doc_id % 17
  WHEN 0 THEN concat('\\frac{1}{', 1 + doc_id % 4, '}') WHEN 1 THEN concat('\\frac1', 1 + doc_id % 4) WHEN 2 THEN concat('1/', 1 + doc_id % 4)
  WHEN 3 THEN concat('\\tfrac{1}{', 1 + doc_id % 4, '}') WHEN 4 THEN '0.5' WHEN 5 THEN '.5' WHEN 6 THEN concat('x=', doc_id % 4) WHEN 7 THEN concat(doc_id % 4, '\\text{ cm}')
  WHEN 8 THEN concat('\\sqrt', doc_id % 4) WHEN 9 THEN concat('\\sqrt{', doc_id % 4, '}') WHEN 10 THEN '\\frac' WHEN 11 THEN 'a/b' WHEN 12 THEN concat('\\left(', doc_id % 4, ', 2\\right)')
  WHEN 13 THEN concat(doc_id % 4, '^{\\circ}') WHEN 14 THEN concat(doc_id % 4, '\\%') WHEN 15 THEN text ELSE concat(doc_id % 4, '') END AS answer FROM documents"""


def _d_normal(src: str, col: str) -> dict[str, str]:
    """CTE steps from a text column to its normal form `v` and flag `fails`."""

    def rep(x: str, *pairs) -> str:
        for a, b in pairs:
            x = f"replace({x}, {D.lit(a)}, {D.lit(b)})"
        return x

    clean = rep(col, ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""))
    unitless = rep(D.before_first("s1", "\\text{ "), ("\\%", ""), (" .", " 0."), ("{.", "{0."))
    return {
        "n1": f"SELECT *, {clean} AS s1 FROM {src}",
        "n2": f"SELECT *, {D.count_of('s1', chr(92) + 'text{ ')} > 1 AS f1, {unitless} AS s2 FROM n1",
        "n3": "SELECT *, CASE WHEN starts_with(s2, '.') THEN concat('0', s2) ELSE s2 END AS s3 FROM n2",
        "n4": "SELECT *, CASE WHEN len(string_split(s3, '=')) = 2 AND length(string_split(s3, '=')[1]) <= 2 THEN string_split(s3, '=')[2] ELSE s3 END AS s4 FROM n3",
        "n5": "SELECT *, f1 OR regexp_matches(s4, '\\\\sqrt(\\\\sqrt|\\z)') AS f2, replace(regexp_replace(s4, '(?s)\\\\sqrt([^{])', '\\\\sqrt{\\1}', 'g'), ' ', '') AS s5 FROM n4",
        "n6": "SELECT *, string_split(s5, '\\frac')[2:] AS ps, list_filter(string_split(s5, '\\frac')[2:], lambda p: p = '' OR (p[1] <> '{' AND length(p) < 2))[1] AS bad FROM n5",
        "n7": """SELECT *, f2 OR coalesce(bad = '', false) AS f3, CASE WHEN bad IS NULL THEN concat(string_split(s5, '\\frac')[1], array_to_string(list_transform(ps, lambda p: concat('\\frac',
            CASE WHEN p[1] = '{' THEN p ELSE concat('{', p[1], '}', CASE WHEN p[2] = '{' THEN '{' ELSE concat('{', p[2], '}') END, p[3:]) END)), '')) ELSE s5 END AS s6 FROM n6""",
        "n8": "SELECT *, CASE WHEN s6 = '0.5' THEN '\\frac{1}{2}' ELSE s6 END AS s7 FROM n7",
        "n9": f"""SELECT *, len(string_split(s7, '/')) = 2 AS one, regexp_matches(string_split(s7, '/')[1], '\\A[{D.WS_CLASS}]*[+-]?\\d+(_\\d+)*[{D.WS_CLASS}]*\\z')
            AND regexp_matches(string_split(s7, '/')[2], '\\A[{D.WS_CLASS}]*[+-]?\\d+(_\\d+)*[{D.WS_CLASS}]*\\z') AS nums,
            regexp_matches(string_split(s7, '/')[1], '\\A(0|-?[1-9][0-9]*)\\z') AND regexp_matches(string_split(s7, '/')[2], '\\A(0|-?[1-9][0-9]*)\\z') AS plain FROM n8""",
        "normal": "SELECT * EXCLUDE (s1, s2, s3, s4, s5, s6, f1, f2), f3 OR (one AND NOT nums) AS fails, CASE WHEN one AND plain THEN concat('\\frac{', string_split(s7, '/')[1], '}{', string_split(s7, '/')[2], '}') ELSE s7 END AS v FROM n9",
    }


@query("math_normalize", D.ctes(a=_ANSWERS, **_d_normal("a", "answer")) + "SELECT doc_id, CASE WHEN NOT fails THEN v END AS normal, fails FROM normal")
def math_normalize(spark, sf):
    df = R.with_normalized(I.run(spark, sf, _ANSWERS), "answer", "v")
    return df.select("doc_id", F.when(~F.col("v_fails"), F.col("v")).alias("normal"), F.col("v_fails").alias("fails"))


_PAIRS = {
    "a": _ANSWERS,
    **_d_normal("a", "answer"),
    "pairs": """SELECT x.doc_id, x.answer AS a, y.answer AS b, x.v AS va, y.v AS vb, x.fails OR y.fails AS fails FROM normal x JOIN normal y ON y.doc_id = x.doc_id + 1""",
}


@query("math_equiv", D.ctes(**_PAIRS) + "SELECT doc_id, CASE WHEN fails THEN a = b ELSE va = vb END AS same FROM pairs")
def math_equiv(spark, sf):
    rows = I.run(spark, sf, _ANSWERS)
    nxt = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("answer").alias("b"))
    return R.with_equiv(rows.join(nxt, "doc_id"), "answer", "b", "same").select("doc_id", "same")


_TRUTH = "concat('\\boxed{\\frac1', 1 + doc_id % 4, '}')"


@query(
    "reward_math",
    D.ctes(**BOX, x=f"SELECT doc_id, coalesce(inner_text, completion) AS answer, concat('\\frac{{1}}{{', 1 + doc_id % 4, '}}') AS want, concat('\\frac1', 1 + doc_id % 4) AS raw FROM u", **_d_normal("x", "answer"))
    + "SELECT doc_id, CASE WHEN CASE WHEN fails THEN answer = raw ELSE v = want END THEN 2.0::DOUBLE ELSE 0 END AS reward FROM normal",
)
def reward_math(spark, sf):
    truth = F.concat(F.lit("\\boxed{\\frac1"), (1 + F.col("doc_id") % 4).cast("string"), F.lit("}"))
    return R.with_math_reward(_roll(spark, sf).withColumn("solution", truth), "completion", "solution").select("doc_id", "reward")


@query(
    "reward_boxed_tags",
    _reward_sql(
        f"""0.5::DOUBLE * (CASE WHEN contains(completion, '<answer>') THEN 1 ELSE 0 END + CASE WHEN contains(CASE WHEN contains(completion, '<answer>')
        THEN {D.before_first("string_split(completion, '<answer>')[2]", '</answer>')} ELSE completion END, '\\boxed') THEN 1 ELSE 0.5 END)"""
    ),
)
def reward_boxed_tags(spark, sf):
    return _roll(spark, sf).select("doc_id", R.boxed_tags(c()).alias("reward"))


# ---- countdown and sudoku ------------------------------------------------------------

_COUNTDOWN = """SELECT doc_id, 1 + doc_id % 9 AS a, 1 + doc_id % 7 AS b, 1 + doc_id % 5 AS c, CASE doc_id % 10
  WHEN 0 THEN concat(text, '<answer>', 1 + doc_id % 9, ' + ', 1 + doc_id % 7, ' * ', 1 + doc_id % 5, '</answer>')
  WHEN 1 THEN concat(text, '<answer>(', 1 + doc_id % 9, '-', 1 + doc_id % 7, ')/', 1 + doc_id % 5, '</answer>')
  WHEN 2 THEN concat('<answer>', 1 + doc_id % 9, '+', 1 + doc_id % 7, '</answer>') WHEN 3 THEN text
  WHEN 4 THEN concat('<answer>1</answer>', text, '<answer>', chr(10), '-', 1 + doc_id % 9, '*(', 1 + doc_id % 7, '-(', 1 + doc_id % 5, '))</answer>')
  WHEN 5 THEN concat('<answer>', 1 + doc_id % 9, ' ', 1 + doc_id % 7, ' ', 1 + doc_id % 5, '</answer>')
  WHEN 6 THEN concat('<answer>', 1 + doc_id % 9, '/(', 1 + doc_id % 7, '-', 1 + doc_id % 5, ')</answer>')
  WHEN 7 THEN concat('<answer>', 1 + doc_id % 9, '**', 1 + doc_id % 7, ' // ', 1 + doc_id % 5, '</answer>')
  WHEN 8 THEN concat(text, '<answer>-', 1 + doc_id % 9, '//', 1 + doc_id % 7, '**-', 1 + doc_id % 5, '</answer>')
  ELSE concat('<answer>', 1 + doc_id % 9, '+', 1 + doc_id % 7, '+', 1 + doc_id % 5, ' apples</answer>') END AS completion FROM documents"""
_VALUE = """CASE doc_id % 10 WHEN 0 THEN a + b * c WHEN 1 THEN (a - b) / c WHEN 2 THEN a + b WHEN 4 THEN -a * (b - c) WHEN 6 THEN CASE WHEN b <> c THEN a / (b - c) END
  WHEN 7 THEN floor(pow(a, b) / c) WHEN 8 THEN floor(-a / pow(b, -c)) END"""
_TARGET = "(CASE WHEN doc_id % 10 = 7 THEN CAST(floor(pow(a, b) / c) AS BIGINT) ELSE a + b * c END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)"


@query(
    "reward_countdown",
    D.ctes(x=_COUNTDOWN)
    + f"SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 0.0::DOUBLE WHEN doc_id % 10 <> 2 AND abs({_VALUE} - {_TARGET}) < 1e-5 THEN 1 ELSE 0.1 END AS reward FROM x",
)
def reward_countdown(spark, sf):
    df = I.run(spark, sf, _COUNTDOWN)
    df = df.withColumn("numbers", F.array("c", "a", "b")).withColumn("target", F.expr(_TARGET))
    return R.with_countdown_reward(df, "completion", "numbers", "target").select("doc_id", "reward")


@query("countdown_value", D.ctes(x=_COUNTDOWN) + f"SELECT doc_id, round(CAST({_VALUE} AS DOUBLE), 6) AS value FROM x")
def countdown_value(spark, sf):
    df = I.run(spark, sf, _COUNTDOWN)
    return df.select("doc_id", F.round(R.arithmetic(R.last_answer(c())), 6).alias("value"))


_SUDOKU = f"""SELECT doc_id, completion, '1234341221434321' AS solution, concat(""" + ", ".join(
    f"CASE WHEN (doc_id + {i}) % 3 = 0 THEN '0' ELSE '{d}' END" for i, d in enumerate("1234341221434321")
) + f") AS puzzle FROM ({I.ROLLOUTS}) r"
_LAST = "regexp_extract_all(completion, '<answer>(.*?)</answer>', 1, 's')[-1]"
_GRID = f"rpad(regexp_replace({_LAST}, '[^0-9]', '', 'g'), 16, '0')"


@query(
    "reward_sudoku",
    D.ctes(x=_SUDOKU, g=f"SELECT *, regexp_replace({_LAST}, '[^0-9]', '', 'g') AS digits, {_GRID} AS grid FROM x")
    + """SELECT doc_id, CASE WHEN coalesce(digits, '') = '' THEN 0 ELSE round(len(list_filter(range(1, 17), lambda i: substr(puzzle, i, 1) = '0' AND substr(grid, i, 1) = substr(solution, i, 1)))
      / len(list_filter(range(1, 17), lambda i: substr(puzzle, i, 1) = '0')), 6) END AS reward FROM g""",
)
def reward_sudoku(spark, sf):
    df = R.with_sudoku_reward(I.run(spark, sf, _SUDOKU), "completion", "puzzle", "solution")
    return df.select("doc_id", F.round("reward", 6).alias("reward"))


# ---- code -----------------------------------------------------------------------

_CODE = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat(text, chr(10), '```python', chr(10), body, '```')
    WHEN 1 THEN concat(text, '<answer>', chr(10), '```python', chr(10), body, '```', chr(10), '</answer>')
    WHEN 2 THEN concat('```python', chr(10), 'import os', chr(10), body, '```') WHEN 3 THEN text
    ELSE concat('<answer>```python', chr(10), 'x = 1', chr(10), '```</answer>') END AS completion,
  CASE doc_id % 4 WHEN 0 THEN concat('from solution import f0', chr(10), chr(10), 'def test_a():', chr(10), '    assert f0(1) == 1', chr(10), 'def test_b():', chr(10), '    assert f0(2) == 2')
    WHEN 1 THEN concat('assert f0(1) == 1', chr(10), '  assert f0(2) == 2', chr(10), 'x = 2', chr(10), 'assert f0(3) == 3') WHEN 2 THEN 'print(1)'
    ELSE concat('from solution import f1', chr(10), 'def test_one():', chr(10), '    assert f1(1)', chr(10)) END AS tests
  FROM (SELECT *, concat('def f', doc_id % 3, '(x):', chr(10), '    return f', doc_id % 3, 'x or x', chr(10)) AS body FROM documents) d"""
_RESULTS = " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS test_name, (doc_id + {k}) % 2 = 0 AS passed FROM documents"
    for name, k in (("test_a", 0), ("test_b", 1), ("test_case_1", 0), ("test_case_2", 1))
)
_NAMES = "regexp_extract_all({x}, 'def (\\w+)\\(\\):', 1)"
CODE = {
    "x": _CODE,
    "p": """SELECT *, regexp_extract(completion, '(?s)```python\\n(.*?)```', 1) AS code0, regexp_extract(completion, '(?s)<answer>(.*?)</answer>', 1) AS section,
      coalesce(nullif(regexp_extract(tests, 'from solution import (\\w+)', 1), ''), nullif(regexp_extract(tests, 'assert\\s+(\\w+)\\s*\\(', 1), '')) AS target FROM x""",
    "d": "SELECT *, code0 <> '' AND contains(section, concat('```python', chr(10), code0, '```')) AS in_answer, nullif(regexp_extract(code0, 'def (\\w+)\\(', 1), '') AS defined FROM p",
    # the rollouts define f0, f1 or f2, so one pattern renames them all
    "n": "SELECT *, CASE WHEN defined <> target THEN regexp_replace(code0, '\\bdef f[0-2]\\b', concat('def ', target), 'g') ELSE code0 END AS code FROM d",
    "q": f"SELECT *, target IS NOT NULL AND defined IS NOT NULL AND NOT ({' OR '.join(f'contains(code, {D.lit(b)})' for b in R.BLOCKED)}) AS runnable FROM n",
    "a": f"""SELECT *, list_filter(list_transform(string_split({D.strip('tests')}, chr(10)), lambda l: {D.strip('l')}), lambda l: starts_with(l, 'assert')) AS asserts, {_NAMES.format(x='tests')} AS names0 FROM q""",
    "z": """SELECT *, CASE WHEN len(names0) <= 1 THEN array_to_string(list_transform(asserts, lambda l, i: concat('def test_case_', i, '():', chr(10), '    ', l)), chr(10) || chr(10)) ELSE tests END AS test_code FROM a""",
    "m": f"SELECT *, {_NAMES.format(x='test_code')} AS test_names FROM z",
}


def _prepared(spark, sf):
    return R.prepare_code(I.run(spark, sf, _CODE), "completion", "tests")


@query("extract_program", D.ctes(**CODE) + "SELECT doc_id, code0 AS code, coalesce(in_answer, false) AS in_answer FROM d")
def extract_program(spark, sf):
    df = I.run(spark, sf, _CODE).withColumn("code", R.program(c()))
    return df.select("doc_id", "code", R.in_answer(c(), F.col("code")).alias("in_answer"))


@query("test_target", D.ctes(**CODE) + "SELECT doc_id, target FROM p")
def test_target(spark, sf):
    return I.run(spark, sf, _CODE).select("doc_id", R.test_target(F.col("tests")).alias("target"))


@query("rename_entry_point", D.ctes(**CODE) + "SELECT doc_id, code FROM n WHERE defined IS NOT NULL AND target IS NOT NULL")
def rename_entry_point(spark, sf):
    df = _prepared(spark, sf).filter((R.defined_name(R.program(c()))).isNotNull() & F.col("test_target").isNotNull())
    return df.select("doc_id", "code")


_SAFE = f"SELECT doc_id, NOT ({' OR '.join(f'contains(text, {D.lit(b)})' for b in R.BLOCKED)}) AS safe FROM documents"


@query("screen_unsafe", _SAFE)
def screen_unsafe(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", R.is_safe(F.col("text")).alias("safe"))


@query("split_asserts", D.ctes(**CODE) + "SELECT doc_id, test_code, array_to_string(test_names, ',') AS names FROM m")
def split_asserts(spark, sf):
    return _prepared(spark, sf).select("doc_id", "test_code", F.array_join("test_names", ",").alias("names"))


_OUTCOME = """SELECT e.doc_id, count_if(coalesce(passed, false)) AS n_passed, count(*) AS n_tests FROM (SELECT doc_id, unnest(test_names) AS test_name FROM m WHERE runnable) e
  LEFT JOIN results r ON e.doc_id = r.doc_id AND e.test_name = r.test_name GROUP BY e.doc_id"""


@query("join_test_results", D.ctes(**CODE, results=_RESULTS, o=_OUTCOME) + "SELECT doc_id, CAST(n_passed AS BIGINT) AS n_passed, n_tests FROM o")
def join_test_results(spark, sf):
    return R.join_test_results(_prepared(spark, sf), I.run(spark, sf, _RESULTS), "doc_id")


@query(
    "reward_code",
    D.ctes(**CODE, results=_RESULTS, o=_OUTCOME)
    + """SELECT m.doc_id, round(CASE WHEN target IS NULL THEN 0 ELSE CASE WHEN in_answer THEN 0.5 ELSE 0 END
      + CASE WHEN runnable AND n_tests > 0 THEN n_passed / n_tests ELSE 0 END END, 6)::DOUBLE AS reward FROM m LEFT JOIN o ON m.doc_id = o.doc_id""",
)
def reward_code(spark, sf):
    out = R.code_reward(_prepared(spark, sf), I.run(spark, sf, _RESULTS), "doc_id")
    return out.select("doc_id", F.round("reward", 6).alias("reward"))


# ---- rollout statistics ----------------------------------------------------------------

NAMES = ["xmlcount", "soft_format", "strict_format", "int", "correctness"]


def scored(spark, sf):
    """All text rewards of the word-problem task, one row per rollout and reward."""
    rows = _roll(spark, sf).withColumnRenamed("truth", "answer")
    return TK.long_rewards(TK.score(rows, TK.task("gsm8k").rewards), ["group_id", "doc_id"], NAMES)


def with_gaps(spark, sf):
    """The same with a missing reward on every seventh rollout."""
    gap = (F.col("doc_id") % 7 == 0) & (F.col("func") == "int")
    return scored(spark, sf).withColumn("reward", F.when(~gap, F.col("reward")))


LONG = {
    **ROLL,
    "s": f"SELECT group_id, doc_id, {_XMLCOUNT} AS xmlcount, {_SOFT} AS soft_format, {_STRICT} AS strict_format, {_INT} AS int_r, CASE WHEN {_XML} = truth THEN 2.0::DOUBLE ELSE 0 END AS correctness FROM r",
    "l": """SELECT group_id, doc_id, 'xmlcount' AS func, xmlcount AS reward FROM s UNION ALL SELECT group_id, doc_id, 'soft_format', soft_format FROM s
      UNION ALL SELECT group_id, doc_id, 'strict_format', strict_format FROM s UNION ALL SELECT group_id, doc_id, 'int', CASE WHEN doc_id % 7 <> 0 THEN int_r END FROM s
      UNION ALL SELECT group_id, doc_id, 'correctness', correctness FROM s""",
    "t": "SELECT group_id, doc_id, coalesce(sum(reward * CASE func WHEN 'int' THEN 2.0 ELSE 1.0 END), 0) AS reward FROM l GROUP BY group_id, doc_id",
    "g": "SELECT group_id, avg(reward) AS m, stddev_samp(reward) AS sd FROM t GROUP BY group_id",
}
WEIGHTS = {"int": 2.0}


def totals(spark, sf):
    return M.reward_total(with_gaps(spark, sf), ["group_id", "doc_id"], WEIGHTS)


_BY_TASK = " UNION ALL ".join(
    f"SELECT '{t}' AS task, doc_id, '{func}' AS func, reward FROM ({ORACLE[q]}) {t}_{func}"
    for t, func, q in (
        ("countdown", "countdown", "reward_countdown"), ("sudoku", "sudoku", "reward_sudoku"), ("math", "math", "reward_math"),
        ("math", "boxed_tags", "reward_boxed_tags"), ("code", "code", "reward_code"),
    )
)


@query(
    "task_catalog",
    D.ctes(**LONG, code_rows=_CODE)
    + f"""SELECT 'gsm8k' AS task, doc_id, unnest(['xmlcount', 'soft_format', 'strict_format', 'int', 'correctness']) AS func,
        unnest([round(xmlcount, 6), soft_format, strict_format, int_r, correctness]) AS reward FROM s
      UNION ALL SELECT 'code', doc_id, 'xmlcount', round({_XMLCOUNT}, 6) FROM code_rows UNION ALL {_BY_TASK}""",
)
def task_catalog(spark, sf):
    """All five tasks, each with all its rewards."""
    truth = F.concat(F.lit("\\boxed{\\frac1"), (1 + F.col("doc_id") % 4).cast("string"), F.lit("}"))
    rows = {
        "gsm8k": _roll(spark, sf).withColumnRenamed("truth", "answer"),
        "countdown": I.run(spark, sf, _COUNTDOWN).withColumn("numbers", F.array("c", "a", "b")).withColumn("target", F.expr(_TARGET)),
        "sudoku": I.run(spark, sf, _SUDOKU),
        "math": _roll(spark, sf).withColumn("answer", truth),
        "code": I.run(spark, sf, _CODE),
    }
    parts = []
    for name, df in rows.items():
        rewards = TK.task(name, I.run(spark, sf, _RESULTS)).rewards
        long = TK.long_rewards(TK.score(df, rewards).select("doc_id", *[F.round(F.col(r).cast("double"), 6).alias(r) for r in rewards]), ["doc_id"], list(rewards))
        parts.append(long.withColumn("task", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts).select("task", "doc_id", "func", "reward")


@query("reward_total", D.ctes(**LONG) + "SELECT group_id, doc_id, round(reward, 6) AS reward FROM t")
def reward_total(spark, sf):
    return totals(spark, sf).select("group_id", "doc_id", F.round("reward", 6).alias("reward"))


@query(
    "group_advantage",
    D.ctes(**LONG) + "SELECT doc_id, round(reward - m, 6) AS advantage, round((reward - m) / (sd + 1e-4), 4) AS scaled FROM t JOIN g USING (group_id)",
)
def group_advantage(spark, sf):
    out = M.group_advantage(totals(spark, sf), "group_id")
    scaled = F.col("advantage") / (F.col("group_std") + 1e-4)
    return out.select("doc_id", F.round("advantage", 6).alias("advantage"), F.round(scaled, 4).alias("scaled"))


_FLAT = "SELECT doc_id % 200 AS group_id, CASE WHEN doc_id % 200 < 50 THEN 1.0::DOUBLE ELSE CAST(n_chars AS DOUBLE) END AS reward FROM documents"


@query("zero_std_share", D.ctes(f=_FLAT, g="SELECT group_id, stddev_samp(reward) AS sd FROM f GROUP BY group_id") + "SELECT round(avg(CASE WHEN abs(sd) <= 1e-8 THEN 1.0 ELSE 0.0 END), 6) AS frac_reward_zero_std FROM g")
def zero_std_share(spark, sf):
    d = F.col("doc_id") % 200
    rows = I.table(spark, sf, "documents").select(d.alias("group_id"), F.when(d < 50, 1.0).otherwise(F.col("n_chars").cast("double")).alias("reward"))
    out = M.zero_std_share(rows, "group_id")
    return out.select(F.round("frac_reward_zero_std", 6).alias("frac_reward_zero_std"))


@query(
    "reward_stats",
    D.ctes(**LONG) + "SELECT func, round(avg(reward), 6) AS mean, round(stddev_samp(reward), 6) AS std FROM l GROUP BY func UNION ALL SELECT 'total', round(avg(m), 6), round(avg(sd), 6) FROM g",
)
def reward_stats(spark, sf):
    per = M.reward_stats(with_gaps(spark, sf))
    whole = M.reward_overall(totals(spark, sf), "group_id").select(F.lit("total").alias("func"), F.col("reward").alias("mean"), F.col("reward_std").alias("std"))
    return per.unionByName(whole).select("func", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_LEN = "length(text)"


@query(
    "length_stats",
    """SELECT round(avg(n), 6) AS mean_length, min(n) AS min_length, max(n) AS max_length, round(coalesce(avg(n) FILTER (WHERE e), 0), 6) AS mean_terminated,
    coalesce(min(n) FILTER (WHERE e), 0) AS min_terminated, coalesce(max(n) FILTER (WHERE e), 0) AS max_terminated, round(1 - count_if(e) / count(*), 6) AS clipped_ratio
    FROM (SELECT length(text)::DOUBLE AS n, doc_id % 4 <> 0 AS e FROM documents) d""",
)
def length_stats(spark, sf):
    rows = I.table(spark, sf, "documents").select(F.length("text").alias("n"), (F.col("doc_id") % 4 != 0).alias("e"))
    out = M.length_stats(rows, "n", "e")
    return out.withColumns({k: F.round(k, 6) for k in ("mean_length", "mean_terminated", "clipped_ratio")})


# ---- generation metrics -----------------------------------------------------------------

DIMS = M.ModelDims(2048, 6144, 28, 16, 8, 151936)
_TOK = "CAST(batch_size AS DOUBLE) * query_len"
_D_TRANSFORMER = f"28 * (4.0::DOUBLE * 2048 * (2048 + 1024) * {_TOK} + 4.0::DOUBLE * 2048 * {_TOK} * kv_len + 6.0::DOUBLE * 2048 * 6144 * {_TOK})"
_D_HEAD = f"2.0::DOUBLE * 2048 * 151936 * {_TOK}"
CALLS = {
    "c": I.FORWARD_CALLS,
    "f": f"SELECT *, {_D_TRANSFORMER} AS tf, {_D_HEAD} AS hf, CASE WHEN has_past THEN 'denoise' WHEN use_cache THEN 'prefix' ELSE 'other' END AS category FROM c",
    "b": """SELECT dataset_index, batch_id, count(*) AS model_forward_calls, CAST(count_if(category = 'prefix') AS BIGINT) AS prefix_forward_calls, CAST(count_if(category = 'denoise') AS BIGINT) AS denoise_forward_calls,
      CAST(count_if(category = 'other') AS BIGINT) AS other_forward_calls, CAST(sum(batch_size * query_len) AS BIGINT) AS forward_query_tokens, CAST(sum(batch_size * kv_len) AS BIGINT) AS forward_kv_tokens,
      CAST(coalesce(sum(batch_size * query_len) FILTER (WHERE category = 'prefix'), 0) AS BIGINT) AS prefix_query_tokens,
      CAST(coalesce(sum(batch_size * query_len) FILTER (WHERE category = 'denoise'), 0) AS BIGINT) AS denoise_query_tokens,
      sum(tf) AS estimated_transformer_flops, sum(hf) AS estimated_lm_head_flops, sum(tf + hf) AS estimated_total_flops FROM f GROUP BY dataset_index, batch_id""",
    "w": """SELECT *, model_forward_calls * 0.25::DOUBLE AS wall_seconds, 1 AS sample_batches, 4 AS samples, CASE WHEN batch_id = 0 THEN 1 ELSE 0 END AS instances, forward_query_tokens // 3 AS prompt_tokens,
      forward_query_tokens // 2 AS output_tokens, forward_query_tokens AS canvas_tokens, 4 * 512 AS max_new_tokens_budget FROM b""",
}


def calls(spark, sf):
    return M.forward_flops(I.forward_calls(spark, sf), DIMS)


def batches(spark, sf):
    out = M.forward_counters(calls(spark, sf), ["dataset_index", "batch_id"])
    return out.withColumns(
        {
            "wall_seconds": F.col("model_forward_calls") * 0.25,
            "sample_batches": F.lit(1),
            "samples": F.lit(4),
            "instances": F.when(F.col("batch_id") == 0, 1).otherwise(0),
            "prompt_tokens": F.expr("forward_query_tokens div 3"),
            "output_tokens": F.expr("forward_query_tokens div 2"),
            "canvas_tokens": F.col("forward_query_tokens"),
            "max_new_tokens_budget": F.lit(4 * 512),
        }
    )


@query("forward_flops", D.ctes(**CALLS) + "SELECT call_id, tf AS transformer_flops, hf AS lm_head_flops, tf + hf AS total_flops FROM f")
def forward_flops(spark, sf):
    return calls(spark, sf).select("call_id", "transformer_flops", "lm_head_flops", "total_flops")


_COUNTS = ", ".join(x for x in M.COUNTERS if x.endswith("calls") or x.endswith("query_tokens") or x == "forward_kv_tokens")


@query("forward_category", D.ctes(**CALLS) + f"SELECT dataset_index, batch_id, {_COUNTS} FROM b")
def forward_category(spark, sf):
    return batches(spark, sf).select("dataset_index", "batch_id", *_COUNTS.split(", "))


_SUMS = ", ".join(f"sum({x})::{'DOUBLE' if x == 'wall_seconds' or x.endswith('flops') else 'BIGINT'} AS {x}" for x in M.COUNTERS)


@query("gen_metrics_rollup", D.ctes(**CALLS) + f"SELECT dataset_index, batch_id, {_SUMS} FROM w GROUP BY ROLLUP (dataset_index, batch_id)")
def gen_metrics_rollup(spark, sf):
    return M.rollup_counters(batches(spark, sf), "dataset_index", "batch_id")


def _per(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN {n} / {d} END"


_D_RATIOS = {
    "output_tokens_per_second": _per("output_tokens", "wall_seconds"),
    "canvas_tokens_per_second": _per("canvas_tokens", "wall_seconds"),
    "samples_per_second": _per("samples", "wall_seconds"),
    "instances_per_second": _per("instances", "wall_seconds"),
    "output_tokens_per_diffusion_step": _per("output_tokens", "(denoise_forward_calls / 2)"),
    "canvas_tokens_per_diffusion_step": _per("canvas_tokens", "(denoise_forward_calls / 2)"),
    "forward_query_tokens_per_second": _per("forward_query_tokens", "wall_seconds"),
    "estimated_total_tflops_per_second": _per("estimated_total_flops / 1e12", "wall_seconds"),
    "estimated_transformer_tflops_per_second": _per("estimated_transformer_flops / 1e12", "wall_seconds"),
    "estimated_total_flops_per_output_token": _per("estimated_total_flops", "output_tokens"),
    "estimated_total_flops_per_canvas_token": _per("estimated_total_flops", "canvas_tokens"),
    "estimated_total_flops_per_instance": _per("estimated_total_flops", "instances"),
}
_RATIO_SQL = ", ".join(f"round({v}, {2 if 'flops_per' in k and 'tflops' not in k else 6}) AS {k}" for k, v in _D_RATIOS.items())


def _rounded():
    return [F.round(k, 2 if "flops_per" in k and "tflops" not in k else 6).alias(k) for k in M.RATIOS]


@query(
    "gen_metrics_ratios",
    D.ctes(**CALLS, p=f"SELECT dataset_index, {_SUMS} FROM w GROUP BY dataset_index")
    + f"SELECT dataset_index, 2 AS cfg_forward_multiplier, denoise_forward_calls / 2 AS observed_diffusion_steps, prefix_forward_calls / 2 AS observed_prefix_blocks, {_RATIO_SQL} FROM p",
)
def gen_metrics_ratios(spark, sf):
    out = M.with_ratios(M.sum_counters(batches(spark, sf), ["dataset_index"]), cfg_scale=1.5)
    return out.select("dataset_index", "cfg_forward_multiplier", "observed_diffusion_steps", "observed_prefix_blocks", *_rounded())


def _records(spark, sf):
    """One record per problem, with the counters of its batches; every fourth has no metrics."""
    one = F.struct(*[F.col(c).cast("double" if c == "wall_seconds" or c.endswith("flops") else "bigint").alias(c) for c in M.COUNTERS])
    made = batches(spark, sf).withColumn("b", one)
    sums = [F.sum(f"b.{c}").alias(c) for c in M.COUNTERS]
    per_batch = F.sort_array(F.collect_list(F.struct("batch_id", "b")))["b"]  # as many as a record has batches
    rows = made.groupBy("dataset_index").agg(*sums, per_batch.alias("batch_metrics"))
    samples = F.from_json(F.lit('[{"sample_id": 0}, {"sample_id": 1}]'), f"ARRAY<{RD.SAMPLE}>")
    metrics = F.when(F.col("dataset_index") % 4 != 0, F.struct(*M.COUNTERS, "batch_metrics"))
    return rows.select("dataset_index", F.lit(2).cast("bigint").alias("num_samples"), samples.alias("samples"), metrics.alias("generation_metrics"))


def _merged_records(spark, sf):
    """The records of two ranks and an earlier output, written, read and merged: what the earlier output
    holds is out of date, and the last file holds records without all their samples.
    """
    folder = scratch_dir(spark)
    good = _records(spark, sf)
    old = good.withColumn("generation_metrics", F.col("generation_metrics").withField("output_tokens", F.lit(1).cast("bigint")))
    short = good.withColumn("samples", F.slice("samples", 1, 1))
    even = F.col("dataset_index") % 2 == 0
    files = [old, good.filter(even), good.filter(~even), short]
    for k, rows in enumerate(files):
        W.write_jsonl(rows, f"{folder}/{k}")
    read = [RD.json_tolerant(spark, f"{folder}/{k}", 2).withColumns({"file_no": F.lit(k), "line_no": F.lit(0)}) for k in range(len(files))]
    return G.merge_rank_outputs(G.concat_by_split(*read))


@query(
    "gen_metrics_summary",
    D.ctes(**CALLS, p=f"SELECT {_SUMS}, count(DISTINCT dataset_index) AS records_with_metrics, count(*) AS batches FROM w WHERE dataset_index % 4 <> 0")
    + f"SELECT records_with_metrics, batches, model_forward_calls, {_RATIO_SQL.replace('(denoise_forward_calls / 2)', 'denoise_forward_calls')} FROM p",
)
def gen_metrics_summary(spark, sf):
    """The summary of merged files; the counters of the batches add up to those of the records."""
    records = _merged_records(spark, sf)
    nested = records.select(F.explode("generation_metrics.batch_metrics").alias("b")).select("b.*")
    both = M.metrics_summary(records).withColumns(
        {"batches": nested.agg(F.count(F.lit(1))).scalar(), "_calls": nested.agg(F.sum("model_forward_calls")).scalar()}
    )
    return both.select("records_with_metrics", "batches", F.when(F.col("_calls") == F.col("model_forward_calls"), F.col("_calls")).alias("model_forward_calls"), *_rounded())


@query(
    "block_plan",
    """SELECT doc_id, CAST(ceil(n_chars / 32) AS BIGINT) AS num_blocks, CASE WHEN doc_id % 3 = 0 THEN 7 ELSE CAST(ceil(length(text) / ceil(n_chars / 32)) AS BIGINT) END AS steps_per_block FROM documents WHERE n_chars > 0""",
)
def block_plan(spark, sf):
    explicit = F.when(F.col("doc_id") % 3 == 0, F.lit(7).cast("bigint"))
    plan = M.block_plan(F.col("n_chars"), F.length("text"), F.lit(32), explicit)
    rows = I.table(spark, sf, "documents").filter(F.col("n_chars") > 0).withColumn("p", plan)
    return rows.select("doc_id", "p.num_blocks", "p.steps_per_block")


# ---- sinks of this family ---------------------------------------------------------------


@query(
    "sink_summary",
    D.ctes(**CALLS, n="SELECT DISTINCT dataset_index FROM w", p=f"SELECT {_SUMS}, count(DISTINCT dataset_index) AS records_with_metrics FROM w WHERE dataset_index % 4 <> 0")
    + f"""SELECT (SELECT count(*) FROM n) AS num_examples, (SELECT CAST(count_if(dataset_index % 3 = 0) AS BIGINT) FROM n) AS num_resumed_examples,
      (SELECT CAST(count_if(dataset_index % 3 <> 0) AS BIGINT) FROM n) AS num_new_examples, 2 AS num_samples_per_example, (SELECT count(*) * 2 FROM n) AS total_generations,
      (SELECT CAST(count_if(dataset_index % 3 <> 0) * 2 AS BIGINT) FROM n) AS new_generations, 'test' AS dataset_split, records_with_metrics, 2 AS cfg_forward_multiplier, output_tokens, {_RATIO_SQL} FROM p""",
)
def sink_summary(spark, sf):
    records = _merged_records(spark, sf)
    out = M.run_summary(records, records.filter(F.col("dataset_index") % 3 == 0), 2, {"dataset_split": "test"}, cfg_scale=1.5)
    path = f"{scratch_dir(spark)}/summary"
    W.write_summary(out, path)
    read = spark.read.schema(out.schema).json(path)
    counts = [c for c in read.columns if c != "generation_metrics"]
    metrics = read.select(*counts, "generation_metrics.*")
    return metrics.select(*counts, "records_with_metrics", "cfg_forward_multiplier", "output_tokens", *_rounded())


@query("sink_verified", D.ctes(**VERDICT_CTES) + "SELECT doc_id, pass, complete, system_errors FROM verdicts")
def sink_verified(spark, sf):
    """Verdicts written beside their input file and read back by the reader of records."""
    from evalweave.operators import verify as V

    rows = V.parse_verdict(I.verdicts(spark, sf), "raw_json").select("doc_id", "pass", "complete", "system_errors")
    path = W.write_verified(rows, f"{scratch_dir(spark)}/samples.jsonl")
    return RD.json_records(spark, path, "doc_id BIGINT, pass BOOLEAN, complete BOOLEAN, system_errors STRING")
