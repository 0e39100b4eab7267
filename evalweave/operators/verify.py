"""Statement matching, routing of proofs, verdicts and the reports on them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

from evalweave.functions import text as T
from evalweave.operators import extract as X

# The patterns a declaration, a proof start and a comment follow.
COMMENT = r"(?s)/-.*?-/"
SORRY = r"(?U)\bsorry\b"
# The look-ahead is there for speed: word boundaries are dear to test everywhere.
NAMED_DECLARATION = rf"(?=[tl])\b(?:theorem|lemma)[{T.WS}]+"
NAME = rf"[^{T.WS}:]+"
PROOF_START = rf":=[{T.WS}]*by\b"
PLACEHOLDER = "__THEOREM_NAME__"
EXACT = "exact"
SUBSTITUTE = "substitute"
MATCH_MODES = (EXACT, SUBSTITUTE)

MESSAGE = st.StructType([st.StructField("severity", st.StringType()), st.StructField("data", st.StringType())])
BAD_ANSWER = "json.decoder.JSONDecodeError"


def with_canonical(df: DataFrame, text: str, out: str, statement_only: bool) -> DataFrame:
    """Add a text without comments, `sorry`, the declared name and extra white space.

    Each step is a column of its own, so no regular expression runs twice.
    """
    first = rf"(?Us)\A(.*?{NAMED_DECLARATION})({NAME})"
    plain, before, name = F.col("_plain"), F.col("_before"), F.col("_name")
    kept = F.substr(plain, F.length(before) + F.length(name) + 1)
    bare = F.when(T.has(text, "/-"), F.regexp_replace(F.col(text), COMMENT, "")).otherwise(F.col(text))
    out_df = (
        df.withColumn("_plain", bare)
        .withColumn("_plain", F.when(T.has(plain, "sorry"), F.regexp_replace(plain, SORRY, "")).otherwise(plain))
        .withColumn("_before", F.regexp_extract(plain, first, 1))
        .withColumn("_name", F.when(before != "", F.regexp_extract(plain, first, 2)).otherwise(""))
        .withColumn("_rest", kept)
    )
    if statement_only:
        # The proof start is looked for from where the old name ended, so a name
        # longer than the placeholder hides a start that follows it too closely.
        hidden = F.greatest(F.length(name) - len(PLACEHOLDER), F.lit(0))
        cut, rest = F.col("_cut"), F.col("_rest")
        out_df = out_df.withColumn(
            "_cut", F.regexp_extract(F.substr(rest, hidden + 1), rf"(?Us)\A(.*?{PROOF_START})", 1)
        ).withColumn("_rest", F.when(cut == "", rest).otherwise(F.concat(F.left(rest, hidden), cut)))
    renamed = F.when(name == "", plain).otherwise(F.concat(before, F.lit(PLACEHOLDER), F.col("_rest")))
    return out_df.withColumn(out, F.when(F.col(text) != "", T.collapse_whitespace(renamed))).drop(
        "_plain", "_before", "_name", "_rest", "_cut"
    )


def with_match(df: DataFrame, statement: str, proof: str, out: str) -> DataFrame:
    """Add whether the canonical statement occurs in the canonical proof (neither empty)."""
    s, p = F.col("_statement"), F.col("_proof")
    both = with_canonical(with_canonical(df, statement, "_statement", True), proof, "_proof", False)
    return both.withColumn(out, F.coalesce((s != "") & (p != "") & F.contains(p, s), F.lit(False))).drop(
        "_statement", "_proof"
    )


def with_split(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add struct(prefix, statement, body) around the first declaration, or NULL."""
    whole = rf"(?Us)\A(.*?)({NAMED_DECLARATION}{NAME}.*?{PROOF_START})"
    prefix, statement = F.col("_prefix"), F.col("_stated")
    body = F.substr(F.col(text), F.length(prefix) + F.length(statement) + 1)
    parts = F.struct(prefix.alias("prefix"), statement.alias("statement"), body.alias("body"))
    return (
        df.withColumn("_stated", F.regexp_extract(text, whole, 2))
        .withColumn("_prefix", F.when(statement != "", F.regexp_extract(text, whole, 1)))
        .withColumn(out, F.when(statement != "", parts))
        .drop("_prefix", "_stated")
    )


def with_substitution(df: DataFrame, statement: str, proof: str, out: str) -> DataFrame:
    """Add the proof with its declaration replaced by the target's, where both split."""
    both = with_split(with_split(df, statement, "_target"), proof, "_parts")
    target, prefix, parts = F.col("_goal"), F.col("_lead"), F.col("_parts")
    gap = F.when(prefix != "", F.lit("\n")).otherwise(F.lit(""))
    usable = F.coalesce((target != "") & (T.strip(parts["statement"]) != target), F.lit(False))
    return (
        both.withColumn("_goal", T.strip(F.col("_target")["statement"]))
        .withColumn("_lead", T.rstrip(parts["prefix"]))
        .withColumn(
            out, F.when(usable, T.strip(F.concat(prefix, gap, target, parts["body"]))).otherwise(F.col(proof))
        )
        .drop("_target", "_parts", "_goal", "_lead")
    )


def prepare_match(df: DataFrame, mode: str = EXACT, proof: str = "proof") -> DataFrame:
    """Match each proof with its statement, after substitution where asked for.

    Adds `match_original`, `match_final`, `substituted` and may rewrite the proof.
    """
    if mode not in MATCH_MODES:
        raise ValueError(f"statement match must be one of {MATCH_MODES}, got {mode!r}")
    out = with_match(df, "formal_statement", proof, "match_original")
    if mode == EXACT:
        return out.withColumn("match_final", F.col("match_original")).withColumn("substituted", F.lit(False))
    matched, new, old = F.col("match_original"), F.col("_new"), F.col(proof)
    changed = (
        # NULL in, NULL out: matched proofs skip both the split and the second match.
        out.withColumn("_open", F.when(~matched, old))
        .transform(with_substitution, "formal_statement", "_open", "_new")
        .withColumn("substituted", F.coalesce(new != old, F.lit(False)))
        .withColumn("_open", F.when(F.col("substituted"), new))
    )
    return (
        with_match(changed, "formal_statement", "_open", "_again")
        .withColumn("match_final", F.when(F.col("substituted"), F.col("_again")).otherwise(matched))
        .withColumn(proof, F.coalesce(new, old))
        .drop("_open", "_new", "_again")
    )


def resolved_header(header: Column) -> Column:
    h = T.strip(T.text_or_empty(header))
    return F.when(F.startswith(h, F.lit("import ")), h).otherwise(F.lit(X.DEFAULT_HEADER))


def pick_source(df: DataFrame, out: str = "proof") -> DataFrame:
    """The text to check for each sample: its first usable source, completed.

    Sources in order: verification_source, lean_code_block, last block of the
    completion, of the raw completion, a candidate that looks like Lean.
    """

    def field(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    rows = df.withColumn("_found", F.coalesce(field("verification_source"), field("lean_code_block")))
    for name in ("completion", "raw_completion"):
        if name in df.columns:
            # Only texts without a source so far are searched.
            rows = rows.withColumn("_text", F.when(F.col("_found").isNull() & (F.col(name) != ""), F.col(name)))
            rows = X.with_last_block(rows, "_text", "_block").withColumn("_found", F.coalesce("_found", "_block"))
            rows = rows.drop("_text", "_block", "_blocks")
    candidate = field("candidate_source")
    src = F.col("_source")
    stated = F.when(T.contains_any(src, ("theorem ", "lemma ")), src).otherwise(
        T.strip(F.concat(T.rstrip(T.text_or_empty(field("formal_statement"))), F.lit("\n"), src))
    )
    return (
        rows.withColumn("_source", T.strip(F.coalesce(F.col("_found"), F.when(X.looks_like_lean(candidate), candidate))))
        .withColumn(
            out,
            F.when(src.isNull() | F.startswith(src, F.lit("import ")), src).otherwise(
                T.strip(F.concat(resolved_header(field("header")), F.lit("\n\n"), stated))
            ),
        )
        .drop("_source", "_found")
    )


PROOF = "merged_proof"
#: Fields of a sample that its slot carries along.
CARRIED = ("reasoning", "completion", "raw_completion", "complete_lean_proof_section")
_WIDE = re.compile(rf"(?:{PROOF}|{'|'.join(CARRIED)})_[0-9]+")


def normalize_slots(records: DataFrame) -> DataFrame:
    """One row per proof slot, 1-based, with the slot count `n`, the name `field` of its proof, the
    proof, and the carried fields (NULL where the record has none).

    Three forms of records, told apart row by row: a `samples` array gives a slot per sample, none
    where it is empty, and its fields take the place of a record's of the same name; one ready `merged_proof` gives one slot; `merged_proof_1`, `merged_proof_2`
    and so on give `n` slots (1 if there is no `n`), those without a column an empty proof. A record
    with none of these gives one slot with an empty proof.
    """
    columns = set(records.columns)
    wide = sorted(int(c.rpartition("_")[2]) for c in columns if re.fullmatch(rf"{PROOF}_[0-9]+", c))
    inner = records.schema["samples"].dataType.elementType.names if "samples" in columns else []
    keys = [c for c in records.columns if c not in ("samples", PROOF, "n", *CARRIED, *inner) and not _WIDE.fullmatch(c)]

    def held(name: str) -> Column:
        return F.col(name).isNotNull() if name in columns else F.lit(False)

    def field(name: str) -> Column:
        return (F.col(name) if name in columns else F.lit(None)).cast("string")

    is_wide = F.coalesce(*[F.when(held(f"{PROOF}_{i}"), F.lit(True)) for i in wide], F.lit(False))
    form = F.when(held("samples"), "samples").when(held(PROOF), "one").when(is_wide, "wide").otherwise("none")
    rows = records.withColumn("_form", form)
    parts = []
    if "samples" in columns:
        nested = rows.filter("_form = 'samples'").select(*keys, F.size("samples").alias("n"), F.posexplode("samples").alias("slot", "s"))
        long = nested.select(*keys, "n", (F.col("slot") + 1).alias("slot"), "s.*")
        own = {c: F.col(c) if c in inner else F.lit(None).cast("string") for c in CARRIED}
        section = own["complete_lean_proof_section"]
        own["complete_lean_proof_section"] = F.when(section != "", section).otherwise(X.proof_section(own["completion"]))
        name = F.concat(F.lit(f"{PROOF}_"), F.col("slot").cast("string"))
        parts.append(pick_source(long).select(*keys, "n", "slot", name.alias("field"), "proof", *[v.alias(c) for c, v in own.items()]))
    slots = [(i, F.struct(field(f"{PROOF}_{i}").alias("proof"), *[field(f"{c}_{i}").alias(c) for c in CARRIED])) for i in wide]
    if slots:
        n = F.coalesce(F.col("n").cast("int"), F.lit(1)) if "n" in columns else F.lit(1)
        by_number = F.array(*[dict(slots).get(i, F.lit(None).cast("struct<proof: string, " + ", ".join(f"{c}: string" for c in CARRIED) + ">")) for i in range(1, wide[-1] + 1)])
        each = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.try_element_at(by_number, i)))
        long = rows.filter("_form = 'wide'").select(*keys, n.alias("n"), F.posexplode(each).alias("slot", "s"))
        name = F.concat(F.lit(f"{PROOF}_"), (F.col("slot") + 1).cast("string"))
        parts.append(long.select(*keys, "n", (F.col("slot") + 1).alias("slot"), name.alias("field"), "s.proof", *[f"s.{c}" for c in CARRIED]))
    rest = rows.filter("_form IN ('one', 'none')")
    one = F.lit(1)
    parts.append(rest.select(*keys, one.alias("n"), one.alias("slot"), F.lit(PROOF).alias("field"), field(PROOF).alias("proof"), *[field(c).alias(c) for c in CARRIED]))
    return reduce(lambda a, b: a.unionByName(b), parts)


EMPTY, MISMATCH, CHECK = "empty", "mismatch", "verify"


def route(slots: DataFrame, mode: str = EXACT) -> DataFrame:
    """Decide per slot whether it needs the checker.

    `route` is `empty`, `mismatch` (only for slots with a statement) or
    `verify`; the first two carry their failed verdict already, as `route_verdict`.
    """
    matched = prepare_match(slots, mode)
    stated = T.strip(T.text_or_empty("formal_statement")) != ""
    empty = F.coalesce(F.col("proof") == "", F.lit(True))
    decided = F.when(empty, EMPTY).when(stated & ~F.col("match_final"), MISMATCH).otherwise(CHECK)
    named = F.col("field") if "field" in slots.columns else F.lit(PROOF)
    message = F.when(F.col("route") == EMPTY, F.concat(named, F.lit(" is null or empty"))).when(
        F.col("route") == MISMATCH,
        F.lit(f"formal statement does not match proof (statement_match={mode})"),
    )
    return matched.withColumn("route", decided).withColumn("route_error", message).withColumn("route_verdict", failed_verdict())


def failed_verdict() -> Column:
    """The verdict of a slot that no checker sees, from its route and flags; NULL for others."""
    mismatch = F.col("route") == MISMATCH
    none = F.array().cast("array<struct<data: string>>")
    flags = {"formal_statement_match_original": "match_original", "formal_statement_match": "match_final", "formal_statement_substituted": "substituted"}
    verdict = F.struct(
        F.lit(False).alias("pass"), F.lit(False).alias("complete"), F.array(F.struct(F.col("route_error").alias("data"))).alias("errors"),
        none.alias("warnings"), none.alias("sorries"), F.lit(0.0).alias("verify_time"), F.lit(None).cast("string").alias("system_errors"),
        F.when(mismatch, F.lit(True)).alias("statement_match_failed"), *[F.when(mismatch, F.col(c)).alias(n) for n, c in flags.items()],
    )
    return F.when(F.col("route") != CHECK, verdict)


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.agg(
        F.count_if(F.col("route") == EMPTY).alias("null_count"),
        F.count_if(F.col("substituted") & (F.col("route") != EMPTY)).alias("substitution_count"),
        F.count_if(F.col("route") == MISMATCH).alias("mismatch_count"),
        F.count_if(F.col("route") == CHECK).alias("verify_count"),
    )


def parse_verdict(df: DataFrame, raw: str) -> DataFrame:
    """Turn the checker's raw JSON answer into a verdict.

    An answer that is no JSON object, or whose parts have another shape than a checker
    gives, fails with a system error instead of failing the job; it never passes:
    `messages` that is there but no list, a message without `severity`, and, where the
    proof would otherwise be complete, a warning whose `data` is no text.
    """
    whole = F.try_parse_json(F.col(raw))
    messages = F.try_variant_get(F.col("_v"), "$.messages", "array<variant>")
    sorries = F.try_variant_get(F.col("_v"), "$.sorries", "array<string>")
    no_message = F.array().cast(st.ArrayType(MESSAGE))

    def message(m: Column) -> Column:
        data = F.try_variant_get(m, "$.data", "variant")
        return F.struct(
            F.try_variant_get(m, "$.severity", "string").alias("severity"),
            F.try_variant_get(m, "$.data", "string").alias("data"),
            F.try_variant_get(m, "$.severity", "variant").isNull().alias("_open"),
            F.coalesce(F.schema_of_variant(data) != "STRING", F.lit(True)).alias("_odd"),
        )

    def of(severity: str) -> Column:
        wanted = F.filter("_m", lambda m: m["severity"] == severity)
        return F.coalesce(F.transform(wanted, lambda m: F.struct(m["severity"].alias("severity"), m["data"].alias("data"))), no_message)

    def spoils(m: Column) -> Column:
        return T.has(m["data"], "declaration uses 'sorry'") | T.has(m["data"], "failed")

    listed = F.coalesce(F.schema_of_variant(F.col("_v")).startswith("OBJECT"), F.lit(False)) & (
        F.try_variant_get(F.col("_v"), "$.messages", "variant").isNull() | F.col("_m").isNotNull()
    )
    shaped = listed & ~F.coalesce(F.exists("_m", lambda m: m["_open"]), F.lit(False))
    clean = (F.size(of("error")) == 0) & (F.size("_s") == 0)
    # Warnings are looked at in order, up to the first that settles the matter.
    first = F.get(F.filter("_m", lambda m: (m["severity"] == "warning") & (m["_odd"] | F.coalesce(spoils(m), F.lit(False)))), 0)
    ok = F.col("_ok")
    return (
        df.withColumn("_v", whole)
        .withColumn("_m", F.transform(messages, message))
        .withColumn("_s", F.coalesce(sorries, F.array().cast("array<string>")))
        .withColumn("_first", first)
        .withColumn("_ok", F.coalesce(shaped & ~(clean & F.coalesce(F.col("_first._odd"), F.lit(False))), F.lit(False)))
        .withColumn("system_errors", F.when(~ok, F.lit(BAD_ANSWER)))
        .withColumn("errors", F.when(ok, of("error")))
        .withColumn("warnings", F.when(ok, of("warning")))
        .withColumn("infos", F.when(ok, of("info")))
        .withColumn("sorries", F.when(ok, F.col("_s")))
        .withColumn("pass", ok & F.coalesce(F.size("errors") == 0, F.lit(False)))
        .withColumn("complete", F.col("pass") & (F.size("_s") == 0) & F.col("_first").isNull())
        .drop("_v", "_m", "_s", "_first", "_ok")
    )


def join_verdicts(slots: DataFrame, verdicts: DataFrame, on: list[str]) -> DataFrame:
    """Bring verdicts back to their slots; slots that were not checked keep NULL."""
    return slots.join(verdicts, on, "left")


def failed_routes_as_verdicts(df: DataFrame) -> DataFrame:
    """Complete `pass` and `complete` with the failures the routing decided."""
    failed = F.col("route") != CHECK
    return df.withColumn("pass", F.when(failed, F.lit(False)).otherwise(F.col("pass"))).withColumn(
        "complete", F.when(failed, F.lit(False)).otherwise(F.col("complete"))
    )


def error_class(system_errors: Column) -> Column:
    return (
        F.when(system_errors.isNull(), F.lit("none"))
        .when(T.has(system_errors, "TimeoutExpired"), F.lit("timeout"))
        .when(T.has(system_errors, "json.decoder.JSONDecodeError"), F.lit("json_error"))
        .otherwise(F.lit("other"))
    )


def error_report(verdicts: DataFrame, pass_only: bool = False) -> DataFrame:
    """Counts and percentages of verified, timed out, undecodable and other verdicts."""
    kind = error_class(F.col("system_errors"))
    good = (F.col("pass") & F.col("complete")) if not pass_only else F.col("pass")
    counts = verdicts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(good).alias("n_verified"),
        F.count_if(kind == "timeout").alias("n_timeout"),
        F.count_if(kind == "json_error").alias("n_json_error"),
        F.count_if(kind == "other").alias("n_error"),
    )
    for name in ("verified", "timeout", "json_error", "error"):
        counts = counts.withColumn(f"{name}_ratio", F.round(100 * F.col(f"n_{name}") / F.nullif("total", F.lit(0)), 6))
    return counts


def slot_stats(df: DataFrame) -> DataFrame:
    """Counts per slot and over all slots (`slot` NULL is the total).

    Empty proofs count as null only; a slot whose verdict is missing is valid
    but not verified.
    """
    null = F.col("route") == EMPTY
    checked = ~null & F.col("pass").isNotNull()
    return (
        df.rollup("slot")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(~null).alias("valid"),
            F.count_if(checked).alias("verified"),
            F.count_if(checked & F.col("complete")).alias("complete"),
            F.count_if(checked & F.col("pass")).alias("pass"),
            F.count_if(checked & ~F.col("pass")).alias("error"),
            F.count_if(null).alias("null_count"),
        )
    )


def pass_at_n(df: DataFrame, problem: str = "dataset_index", problems: DataFrame | None = None) -> DataFrame:
    """Share of problems with at least one complete / passing proof.

    `problems` names all problems, so those without any slot count as failed.
    """
    per_problem = df.groupBy(problem).agg(
        F.max("slot").alias("n"),
        F.bool_or("complete").alias("any_complete"),
        F.bool_or("pass").alias("any_pass"),
    )
    if problems is not None:
        per_problem = problems.select(problem).join(per_problem, problem, "left")
    out = per_problem.agg(
        F.max("n").alias("n"),
        F.count(F.lit(1)).alias("total_problems"),
        F.count_if("any_complete").alias("problems_with_complete"),
        F.count_if("any_pass").alias("problems_with_pass"),
    )
    total = F.nullif("total_problems", F.lit(0))
    return out.withColumn("complete_pct", F.round(100 * F.col("problems_with_complete") / total, 6)).withColumn(
        "pass_pct", F.round(100 * F.col("problems_with_pass") / total, 6)
    )


def verified_ratio(verdicts: DataFrame) -> DataFrame:
    """Share of complete verdicts among slots that have one."""
    out = verdicts.agg(
        F.count("pass").alias("total_count"), F.count_if(F.col("complete")).alias("verified_count")
    )
    return out.withColumn("ratio", F.round(F.col("verified_count") / F.nullif("total_count", F.lit(0)), 6))


def coverage(stats_total: DataFrame) -> DataFrame:
    """Ratios of valid, verified and complete proofs from the TOTAL row of `slot_stats`."""

    def pct(a: str, b: str) -> Column:
        return F.coalesce(F.round(100 * F.col(a) / F.nullif(b, F.lit(0)), 6), F.lit(0.0))

    return stats_total.select(
        F.col("total").alias("expected"),
        "valid",
        "verified",
        "complete",
        pct("valid", "total").alias("valid_pct"),
        pct("null_count", "total").alias("null_pct"),
        pct("verified", "valid").alias("verified_pct"),
        pct("complete", "verified").alias("complete_pct"),
        pct("pass", "verified").alias("pass_pct"),
        pct("error", "verified").alias("error_pct"),
    )
