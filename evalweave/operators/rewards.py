"""Text rewards over rollouts.

Simple rewards are Column functions of the completion. Rewards with several
steps are DataFrame functions that keep each step in a column of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import arrays as A
from evalweave.functions import text as T

# Tags, layouts, weights and the blocked names of a program.
ANSWER = r"(?s)<answer>(.*?)</answer>"
STRICT_LAYOUT = r"(?s)\A<reasoning>\n.*?\n</reasoning>\n<answer>\n.*?\n</answer>\n\n?\z"
SOFT_LAYOUT = rf"(?s)\A<reasoning>.*?</reasoning>[{T.WS}]*<answer>.*?</answer>"
DIGITS = r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
BLOCKED = (
    " os", " sys", " subprocess", " shutil", " socket", " psutil", " ctypes", " pathlib", " builtins", "__import__",
)


def _score(ok: Column, value: float) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))


# ---- format ------------------------------------------------------------------


def xml_answer(text: Column) -> Column:
    """Text after the last <answer> up to the next </answer>, stripped."""
    return T.strip(T.before_first(T.after_last(text, "<answer>"), "</answer>"))


def xmlcount(text: Column) -> Column:
    """An eighth per tag that occurs once, less a little per trailing character."""
    share = F.lit(0.125)

    def once(tag: str) -> Column:
        return T.count_of(text, tag) == 1

    def trailing(tag: str) -> Column:
        return F.length(T.after_last(text, tag))

    none = F.lit(0.0)
    return (
        F.when(once("<reasoning>\n"), share).otherwise(none)
        + F.when(once("\n</reasoning>\n"), share).otherwise(none)
        + F.when(once("\n<answer>\n"), share - trailing("\n</answer>\n") * F.lit(0.001)).otherwise(none)
        + F.when(once("\n</answer>"), share - (trailing("\n</answer>") - 1) * F.lit(0.001)).otherwise(none)
    )


def strict_format(text: Column) -> Column:
    return _score(F.rlike(text, F.lit(STRICT_LAYOUT)), 0.5)


def soft_format(text: Column) -> Column:
    return _score(F.rlike(text, F.lit(SOFT_LAYOUT)), 0.5)


def length_reward(text: Column) -> Column:
    return -F.length(text)


def exact(text: Column, truth: Column) -> Column:
    return _score(xml_answer(text) == truth, 2.0)


def is_int(text: Column) -> Column:
    return _score(F.rlike(xml_answer(text), F.lit(rf"\A[{DIGITS}]+\z")), 0.5)


# ---- boxed answers -------------------------------------------------------------


def _balanced(tail: Column) -> Column:
    """The start of a text up to where its braces balance, NULL if they never do.

    Works on pieces that end in a brace, not on single characters.
    """

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(F.right(piece, F.lit(1)) == "{", 1).otherwise(-1)
        at = acc["at"] + F.length(piece)
        closes = (F.right(piece, F.lit(1)) == "}") & (depth == 0) & acc["end"].isNull()
        return F.struct(
            depth.cast("int").alias("depth"), at.cast("int").alias("at"), F.when(closes, at).otherwise(acc["end"]).cast("int").alias("end")
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))
    pieces = F.regexp_extract_all(tail, F.lit("[^{}]*[{}]"), F.lit(0))
    return F.left(tail, F.aggregate(pieces, start, step, lambda acc: acc["end"]))


def boxed_last(text: Column) -> Column:
    """The last box with its command; the text itself if there is none, NULL if
    its braces do not balance.
    """

    def tail(command: str) -> Column:
        return F.concat(F.lit(command), T.after_last(text, command))

    return (
        F.when(T.has(text, "\\boxed "), F.concat(F.lit("\\boxed "), T.before_first(T.after_last(text, "\\boxed "), "$")))
        .when(T.has(text, "\\boxed"), _balanced(tail("\\boxed")))
        .when(T.has(text, "\\fbox"), _balanced(tail("\\fbox")))
        .otherwise(text)
    )


def unboxed(boxed: Column) -> Column:
    """The inside of a box; other text as it is."""
    braces = F.startswith(boxed, F.lit("\\boxed{")) & F.endswith(boxed, F.lit("}"))
    return (
        F.when(F.startswith(boxed, F.lit("\\boxed ")), F.substr(boxed, F.lit(8)))
        .when(braces, F.substr(boxed, F.lit(8), F.length(boxed) - 8))
        .otherwise(boxed)
    )


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def with_normalized(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the normalised LaTeX of an answer, and `<out>_fails` where no normal
    form exists (then answers are compared as they are).
    """
    s = F.col("_s")
    clean = _replaced(
        F.col(text),
        ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
        ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
    )
    units = T.count_of(s, "\\text{ ")
    unitless = _replaced(T.before_first(s, "\\text{ "), ("\\%", ""), (" .", " 0."), ("{.", "{0."))
    led = F.when(F.startswith(s, F.lit(".")), F.concat(F.lit("0"), s)).otherwise(s)
    short_name = (T.count_of(s, "=") == 1) & (F.length(T.before_first(s, "=")) <= 2)
    value = F.when(short_name, T.after_last(s, "=")).otherwise(s)
    roots = F.replace(F.regexp_replace(s, r"(?s)\\sqrt([^{])", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))

    parts = F.split(s, r"\\frac", -1)

    def bad(p: Column) -> Column:
        return (p == "") | (~F.startswith(p, F.lit("{")) & (F.length(p) < 2))

    def braced(p: Column) -> Column:
        second = T.char_at(p, 2)
        tail = F.concat(F.when(second == "{", second).otherwise(F.concat(F.lit("{"), second, F.lit("}"))), F.substr(p, F.lit(3)))
        whole = F.when(F.startswith(p, F.lit("{")), p).otherwise(F.concat(F.lit("{"), T.char_at(p, 1), F.lit("}"), tail))
        return F.concat(F.lit("\\frac"), whole)

    def fractions(ps: Column) -> Column:
        rest = A.tail_from(ps, 1)
        first_bad = F.get(F.filter(rest, bad), 0)
        joined = F.concat(F.get(ps, 0), F.array_join(F.transform(rest, braced), ""))
        return F.struct(
            F.when(first_bad.isNull(), joined).otherwise(s).alias("value"),
            F.coalesce(first_bad == "", F.lit(False)).alias("fails"),
        )

    halves = (T.before_first(s, "/"), T.after_last(s, "/"))
    whole_number = rf"\A[{T.WS}]*[+-]?\p{{Nd}}+(_\p{{Nd}}+)*[{T.WS}]*\z"
    plain_number = r"\A(0|-?[1-9][0-9]*)\z"
    one_slash = T.count_of(s, "/") == 1
    numbers = F.rlike(halves[0], F.lit(whole_number)) & F.rlike(halves[1], F.lit(whole_number))
    plain = F.rlike(halves[0], F.lit(plain_number)) & F.rlike(halves[1], F.lit(plain_number))
    as_fraction = F.concat(F.lit("\\frac{"), halves[0], F.lit("}{"), halves[1], F.lit("}"))
    fails = F.col("_fails")
    return (
        df.withColumn("_s", clean)
        .withColumn("_fails", units > 1)
        .withColumn("_s", unitless)
        .withColumn("_s", led)
        .withColumn("_s", value)
        .withColumn("_fails", fails | F.rlike(s, F.lit(r"\\sqrt(\\sqrt|\z)")))
        .withColumn("_s", roots)
        .withColumn("_f", A.let(parts, fractions))
        .withColumn("_fails", fails | F.col("_f.fails"))
        .withColumn("_s", F.when(F.col("_f.value") == "0.5", F.lit("\\frac{1}{2}")).otherwise(F.col("_f.value")))
        .withColumn("_fails", fails | (one_slash & ~numbers))
        .withColumn(out, F.when(one_slash & plain, as_fraction).otherwise(s))
        .withColumn(f"{out}_fails", fails)
        .drop("_s", "_f", "_fails")
    )


def with_equiv(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add whether two answers are equal in normal form; both NULL are equal."""
    both = with_normalized(with_normalized(df, a, "_a"), b, "_b")
    raw = F.col(a).eqNullSafe(F.col(b))
    fails = F.col("_a_fails") | F.col("_b_fails")
    same = F.when(F.col(a).isNull() | F.col(b).isNull() | fails, raw).otherwise(F.col("_a") == F.col("_b"))
    return both.withColumn(out, same).drop("_a", "_b", "_a_fails", "_b_fails")


def with_math_reward(df: DataFrame, text: str, truth: str, out: str = "reward") -> DataFrame:
    """2 for an equivalent boxed answer. A response whose box does not close is
    taken whole; a truth whose box does not close has no score.
    """
    return (
        df.withColumn("_r", F.coalesce(unboxed(boxed_last(F.col(text))), F.col(text)))
        .withColumn("_t", unboxed(boxed_last(F.col(truth))))
        .transform(with_equiv, "_r", "_t", "_same")
        .withColumn(out, F.when(F.col("_t").isNotNull(), _score(F.col("_same"), 2.0)))
        .drop("_r", "_t", "_same")
    )


def boxed_tags(text: Column) -> Column:
    """Half for answer tags, and half for a box (a quarter without one) in the
    first answer section, or in the text when there is none.
    """
    tagged = T.has(text, "<answer>")
    section = F.when(tagged, T.before_first(F.split_part(text, F.lit("<answer>"), F.lit(2)), "</answer>")).otherwise(text)
    return 0.5 * (F.when(tagged, 1.0).otherwise(0.0) + F.when(T.has(section, "\\boxed"), 1.0).otherwise(0.5))


# ---- countdown -----------------------------------------------------------------

NUMBER = r"\d+\.?\d*|\.\d+"


def arithmetic(expression: Column) -> Column:
    """Value of an expression of numbers, + - * / // ** and parentheses, else NULL.

    One pass over the tokens. The top frame holds the sum so far, the product so far with its
    sign, and the chain of powers that is still open: pairs of a sign and a base, worked out from
    the right when another operator comes, so ** is right-associative, binds closer than a sign
    on its left and less close than one on its right. An open parenthesis puts the frame on a
    stack; a closing one takes it back with its value as the next base. What has no finite real
    value (division by 0, a root of a negative number) gives NULL.
    """
    link = "struct<sign: double, base: double>"
    frame = f"struct<sum: double, side: double, product: double, op: string, chain: array<{link}>, sign: double>"
    zero, one, none = F.lit(0.0), F.lit(1.0), F.lit("")
    no_chain = F.array().cast(f"array<{link}>")

    def make(total: Column, side: Column, product: Column, op: Column, chain: Column, sign: Column) -> Column:
        return F.struct(total.alias("sum"), side.alias("side"), product.alias("product"), op.alias("op"), chain.alias("chain"), sign.alias("sign")).cast(frame)

    def with_base(f: Column, base: Column) -> Column:
        """Frame f with one more link of its chain."""
        new = F.struct(f["sign"].alias("sign"), base.alias("base")).cast(link)
        return make(f["sum"], f["side"], f["product"], f["op"], F.concat(f["chain"], F.array(new)), one)

    def finite(x: Column) -> Column:
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    def power(chain: Column) -> Column:
        """Value of a chain: each base to the power of what stands on its right."""
        last = F.element_at(chain, F.lit(-1))
        rest = F.reverse(F.slice(chain, 1, F.size(chain) - 1))
        return F.aggregate(rest, last["sign"] * last["base"], lambda x, l: l["sign"] * finite(F.pow(l["base"], x)))

    def product(f: Column) -> Column:
        """The product of frame f with its chain as the next factor."""
        x, p = power(f["chain"]), f["product"]
        return F.when(f["op"] == "*", p * x).when(f["op"] == "/", F.try_divide(p, x)).when(f["op"] == "//", F.floor(F.try_divide(p, x)).cast("double")).otherwise(x)

    def total(f: Column) -> Column:
        return f["sum"] + f["side"] * product(f)

    def state(ok: Column, want: Column, top: Column, stack: Column) -> Column:
        return F.struct(ok.alias("ok"), want.alias("want"), top.alias("top"), stack.alias("stack"))

    fresh = make(zero, one, zero, none, no_chain, one)

    def step(s: Column, t: Column) -> Column:
        top, stack, want = s["top"], s["stack"], s["want"]
        is_number = F.rlike(t, F.lit(rf"\A({NUMBER})\z")) & ~F.rlike(t, F.lit(r"\A0+[1-9][0-9]*\z"))
        sign = F.when(t == "-", -1.0).otherwise(1.0)
        signed = make(top["sum"], top["side"], top["product"], top["op"], top["chain"], top["sign"] * sign)
        added = make(total(top), sign, zero, none, no_chain, one)
        times = make(top["sum"], top["side"], product(top), t, no_chain, one)
        closed = with_base(F.try_element_at(stack, F.lit(-1)), total(top))
        rest = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        yes, no = F.lit(True), F.lit(False)
        plus = t.isin("+", "-")
        return (
            F.when(~s["ok"], s)
            .when(is_number & want, state(yes, no, with_base(top, t.try_cast("double")), stack))
            .when(plus & want, state(yes, yes, signed, stack))
            .when(plus, state(added["sum"].isNotNull(), yes, added, stack))
            .when(t.isin("*", "/", "//") & ~want, state(times["product"].isNotNull(), yes, times, stack))
            .when((t == "**") & ~want, state(yes, yes, top, stack))
            .when((t == "(") & want, state(yes, yes, fresh, F.concat(stack, F.array(top))))
            .when((t == ")") & ~want & (F.size(stack) > 0), state(total(top).isNotNull(), no, closed, rest))
            .when((t == "\n") & (F.size(stack) > 0), s)
            .otherwise(state(no, want, top, stack))
        )

    def done(s: Column) -> Column:
        return F.when(s["ok"] & ~s["want"] & (F.size(s["stack"]) == 0), total(s["top"]))

    tokens = F.regexp_extract_all(expression, F.lit(rf"({NUMBER}|\*\*|//|\n|[^\s])"), F.lit(1))
    start = state(F.lit(True), F.lit(True), fresh, F.array().cast(f"array<{frame}>"))
    return F.aggregate(tokens, start, step, done)


def last_answer(text: Column) -> Column:
    """Inside of the last complete answer section, stripped; NULL without one."""
    return T.strip(F.try_element_at(F.regexp_extract_all(text, F.lit(ANSWER), F.lit(1)), F.lit(-1)))


def with_countdown_reward(df: DataFrame, text: str, numbers: str, target: str, out: str = "reward") -> DataFrame:
    """0 without an answer, 1 for a right one, else 0.1.

    Right means: exactly the given numbers are used and the value is the target.
    An expression is worked out only if its numbers fit, so it is short.
    """
    used = F.transform(F.regexp_extract_all("_eq", F.lit(r"(\d+)"), F.lit(1)), lambda n: n.try_cast("bigint"))
    fits = F.array_sort(used) == F.array_sort(F.col(numbers).cast("array<bigint>"))
    right = F.abs(F.col("_value") - F.col(target)) < 1e-5
    return (
        df.withColumn("_eq", last_answer(F.col(text)))
        .withColumn("_value", arithmetic(F.when(F.coalesce(fits, F.lit(False)), F.col("_eq"))))
        .withColumn(out, F.when(F.col("_eq").isNull(), 0.0).when(right, 1.0).otherwise(0.1))
        .drop("_eq", "_value")
    )


# ---- sudoku --------------------------------------------------------------------


def with_sudoku_reward(df: DataFrame, text: str, puzzle: str, solution: str, out: str = "reward") -> DataFrame:
    """Share of the empty cells that are right; short answers are filled with 0."""
    cells = F.sequence(F.lit(1), F.lit(16))
    grid = F.rpad("_digits", 16, "0")

    def empty(i: Column) -> Column:
        return F.substring(F.col(puzzle), i, 1) == "0"

    def right(i: Column) -> Column:
        return empty(i) & (F.substring(F.col("_grid"), i, 1) == F.substring(F.col(solution), i, 1))

    share = F.try_divide(F.size(F.filter(cells, right)), F.size(F.filter(cells, empty)))
    return (
        df.withColumn("_digits", F.regexp_replace(last_answer(F.col(text)), f"[^{DIGITS}]", ""))
        .withColumn("_grid", grid)
        .withColumn(out, F.when(F.col("_digits") != "", F.coalesce(share, F.lit(0.0))).otherwise(0.0))
        .drop("_digits", "_grid")
    )


# ---- code ----------------------------------------------------------------------


def program(text: Column) -> Column:
    """Inside of the first python fence, '' without one."""
    return F.regexp_extract(text, r"(?s)```python\n(.*?)```", 1)


def in_answer(text: Column, code: Column) -> Column:
    """The same fenced program lies in the first answer section."""
    section = F.regexp_extract(text, ANSWER, 1)
    return (code != "") & F.contains(section, F.concat(F.lit("```python\n"), code, F.lit("```")))


def test_target(tests: Column) -> Column:
    """Name of the tested function, NULL when the tests name none."""
    imported = F.regexp_extract(tests, r"(?U)from solution import (\w+)", 1)
    asserted = F.regexp_extract(tests, r"(?U)assert\s+(\w+)\s*\(", 1)
    return F.coalesce(F.nullif(imported, F.lit("")), F.nullif(asserted, F.lit("")))


def defined_name(code: Column) -> Column:
    return F.nullif(F.regexp_extract(code, r"(?U)def (\w+)\(", 1), F.lit(""))


def renamed(code: Column, defined: Column, wanted: Column) -> Column:
    """The program with its function renamed to the tested name."""
    pattern = F.concat(F.lit(r"(?U)\bdef "), defined, F.lit(r"\b"))
    return F.when(defined != wanted, F.regexp_replace(code, pattern, F.concat(F.lit("def "), wanted))).otherwise(code)


def is_safe(code: Column) -> Column:
    return ~T.contains_any(code, BLOCKED)


LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def split_asserts(tests: Column) -> Column:
    """Test functions, one per assert line, when the tests hold at most one
    function; else the tests as they are.
    """
    lines = F.transform(F.split(T.strip(tests), LINE_END, -1), lambda x: T.strip(x))
    asserts = F.filter(lines, lambda x: F.startswith(x, F.lit("assert")))
    cases = F.transform(
        asserts, lambda x, i: F.concat(F.lit("def test_case_"), (i + 1).cast("string"), F.lit("():\n    "), x)
    )
    return F.when(F.size(test_names(tests)) <= 1, F.array_join(cases, "\n\n")).otherwise(tests)


def test_names(tests: Column) -> Column:
    return F.regexp_extract_all(tests, F.lit(r"(?U)def (\w+)\(\):"), F.lit(1))


def prepare_code(df: DataFrame, text: str, tests: str) -> DataFrame:
    """Add program, tests and names as the runner needs them.

    `runnable` rows have outcomes to look up; others are scored without.
    """
    code, target, defined = F.col("code"), F.col("test_target"), F.col("_defined")
    return (
        df.withColumn("code", program(F.col(text)))
        .withColumn("in_answer", in_answer(F.col(text), code))
        .withColumn("test_target", test_target(F.col(tests)))
        .withColumn("_defined", defined_name(code))
        .withColumn("code", F.coalesce(renamed(code, defined, target), code))
        .withColumn("runnable", target.isNotNull() & defined.isNotNull() & is_safe(code))
        .withColumn("test_code", split_asserts(F.col(tests)))
        .withColumn("test_names", test_names(F.col("test_code")))
        .drop("_defined")
    )


def join_test_results(prepared: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Passed and total tests per runnable program; a missing outcome is a failure."""
    wanted = prepared.filter("runnable").select(key, F.explode("test_names").alias("test_name"))
    return (
        wanted.join(results.select(key, "test_name", "passed"), [key, "test_name"], "left")
        .groupBy(key)
        .agg(F.count_if(F.coalesce("passed", F.lit(False))).alias("n_passed"), F.count(F.lit(1)).alias("n_tests"))
    )


def code_reward(prepared: DataFrame, results: DataFrame, key: str, out: str = "reward") -> DataFrame:
    """Share of passed tests, and a half if the program is in the answer.

    Tests without a target score 0; a program that cannot run gets the half only.
    """
    bonus = F.when(F.col("in_answer"), 0.5).otherwise(0.0)
    share = F.coalesce(F.try_divide("n_passed", "n_tests"), F.lit(0.0))
    return (
        prepared.join(join_test_results(prepared, results, key), key, "left")
        .withColumn(
            out,
            F.when(F.col("test_target").isNull(), 0.0).when(~F.col("runnable"), bonus).otherwise(share + bonus),
        )
        .drop("n_passed", "n_tests")
    )
