"""Queries on statement matching, verdicts and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.operators import extract as X
from evalweave.operators import verify as V
from evalweave.plans import duck as D
from evalweave.plans import inputs as I
from evalweave.plans.extraction import RUN, extracted
from evalweave.plans.registry import query

_WS = D.WS_CLASS
_DECL = f"\\b(?:theorem|lemma)[{_WS}]+"
_NAME = f"[^{_WS}:]+"
_START = f":=[{_WS}]*by\\b"


def d_canonical(src: str, col: str, out: str, statement_only: bool) -> str:
    """SELECT that adds the canonical form of a text column."""
    cut = f"regexp_extract(substr(r_, h_ + 1), '(?s)\\A(.*?{_START})', 1)" if statement_only else "''"
    collapsed = D.strip(
        f"regexp_replace(CASE WHEN n_ = '' THEN p_ WHEN {cut} = '' THEN concat(b_, '{V.PLACEHOLDER}', r_)"
        f" ELSE concat(b_, '{V.PLACEHOLDER}', substr(r_, 1, h_), {cut}) END, '[{_WS}]+', ' ', 'g')"
    )
    first = f"(?s)\\A(.*?{_DECL})({_NAME})"
    return f"""SELECT * EXCLUDE (p_, b_, n_, r_, h_), CASE WHEN {col} <> '' THEN {collapsed} END AS {out} FROM
      (SELECT *, substr(p_, length(b_) + length(n_) + 1) AS r_, greatest(length(n_) - {len(V.PLACEHOLDER)}, 0) AS h_ FROM
      (SELECT *, regexp_extract(p_, '{first}', 1) AS b_, regexp_extract(p_, '{first}', 2) AS n_ FROM
      (SELECT *, regexp_replace(regexp_replace({col}, '/-.*?-/', '', 'gs'), '\\bsorry\\b', '', 'g') AS p_ FROM {src}) x1) x2) x3"""


def d_match(src: str, col: str, out: str) -> str:
    """SELECT that adds whether the statement occurs in a proof column."""
    return f"""SELECT * EXCLUDE (cs_, cp_), coalesce(cs_ <> '' AND cp_ <> '' AND contains(cp_, cs_), false) AS {out} FROM
      ({d_canonical(f"({d_canonical(src, 'formal_statement', 'cs_', True)}) y1", col, 'cp_', False)}) y2"""


_SPLIT = f"(?s)\\A(.*?)({_DECL}{_NAME}.*?{_START})"
_LOOKS = f"""(s_ <> '' AND NOT ({" OR ".join(f"contains(s_, {D.lit(m)})" for m in X.NOT_LEAN_MARKERS)})
  AND (starts_with(s_, 'import ') OR {" OR ".join(f"contains(s_, {D.lit(m)})" for m in X.LEAN_MARKERS)}))"""


def slots_ctes() -> dict[str, str]:
    """CTEs from the tables to one proof per sample."""
    stated = f"CASE WHEN contains(src, 'theorem ') OR contains(src, 'lemma ') THEN src ELSE {D.strip(D.rstrip('formal_statement') + ' || chr(10) || src')} END"
    parts = extracted()
    parts["candidates"] = f"SELECT *, {D.strip('candidate_source')} AS s_ FROM fields"
    parts["found"] = f"""SELECT *, {D.strip(f"coalesce(verification_source, lean_code_block, last_block, CASE WHEN {_LOOKS} THEN candidate_source END)")} AS src FROM candidates"""
    parts["slots"] = f"""SELECT dataset_index, sample_id, sample_id + 1 AS slot, doc_id, formal_statement,
      CASE WHEN src IS NULL OR starts_with(src, 'import ') THEN src
           ELSE {D.strip(f"{D.lit(X.DEFAULT_HEADER)} || chr(10) || chr(10) || {stated}")} END AS proof FROM found"""
    return parts


def routed_ctes(mode: str) -> dict[str, str]:
    parts = slots_ctes()
    parts["m1"] = d_match("slots", "proof", "match_original")
    if mode == V.EXACT:
        parts["m2"] = "SELECT *, match_original AS match_final, false AS substituted FROM m1"
    else:
        parts["halves"] = f"""SELECT *, {D.strip(f"regexp_extract(formal_statement, '{_SPLIT}', 2)")} AS target,
          regexp_extract(proof, '{_SPLIT}', 1) AS pre, regexp_extract(proof, '{_SPLIT}', 2) AS st FROM m1"""
        parts["swapped"] = f"""SELECT * EXCLUDE (proof), proof AS old_proof, CASE WHEN NOT match_original AND target <> '' AND st <> '' AND {D.strip('st')} <> target
          THEN {D.strip(f"concat({D.rstrip('pre')}, CASE WHEN {D.rstrip('pre')} <> '' THEN chr(10) ELSE '' END, target, substr(proof, length(pre) + length(st) + 1))")} ELSE proof END AS proof FROM halves"""
        parts["m2"] = f"SELECT *, coalesce(proof <> old_proof, false) AS substituted FROM ({d_match('swapped', 'proof', 'match_final')}) z"
    parts["routed"] = f"""SELECT *, CASE WHEN coalesce(proof, '') = '' THEN 'empty'
      WHEN {D.strip('formal_statement')} <> '' AND NOT match_final THEN 'mismatch' ELSE 'verify' END AS route FROM m2"""
    return parts


_STATEMENTS = D.ctes(problems=I.PROBLEMS)


@query(
    "canonicalize_statement",
    _STATEMENTS
    + f"""SELECT dataset_index, statement, whole FROM ({d_canonical(f"({d_canonical('problems', 'formal_statement', 'statement', True)}) a", 'formal_statement', 'whole', False)}) b""",
)
def canonicalize_statement(spark, sf):
    df = V.with_canonical(I.problems(spark, sf), "formal_statement", "statement", True)
    return V.with_canonical(df, "formal_statement", "whole", False).select("dataset_index", "statement", "whole")


@query(
    "split_statement_body",
    _STATEMENTS
    + f"""SELECT dataset_index, CASE WHEN st <> '' THEN pre END AS prefix, nullif(st, '') AS statement,
      CASE WHEN st <> '' THEN substr(formal_statement, length(pre) + length(st) + 1) END AS body FROM
      (SELECT *, regexp_extract(formal_statement, '{_SPLIT}', 1) AS pre, regexp_extract(formal_statement, '{_SPLIT}', 2) AS st FROM problems) h""",
)
def split_statement_body(spark, sf):
    df = V.with_split(I.problems(spark, sf), "formal_statement", "p")
    return df.select("dataset_index", "p.prefix", "p.statement", "p.body")


def _slots(spark, sf):
    """One proof per sample, in long form all the way."""
    fields = X.add_sample_fields(I.samples(spark, sf))
    return V.pick_source(fields).select(
        "dataset_index", "sample_id", (F.col("sample_id") + 1).alias("slot"), "doc_id", "formal_statement", "proof"
    )


@query("pick_verification_source", D.ctes(**slots_ctes()) + "SELECT dataset_index, slot, proof FROM slots")
def pick_verification_source(spark, sf):
    return _slots(spark, sf).select("dataset_index", "slot", "proof")


@query("statement_matches", D.ctes(**slots_ctes(), m=d_match("slots", "proof", "matched")) + "SELECT dataset_index, slot, matched FROM m")
def statement_matches(spark, sf):
    return V.with_match(_slots(spark, sf), "formal_statement", "proof", "matched").select("dataset_index", "slot", "matched")


@query("substitute_statement", D.ctes(**routed_ctes(V.SUBSTITUTE)) + "SELECT dataset_index, slot, proof, substituted FROM routed")
def substitute_statement(spark, sf):
    return V.prepare_match(_slots(spark, sf), V.SUBSTITUTE).select("dataset_index", "slot", "proof", "substituted")


@query(
    "prepare_match",
    D.ctes(**routed_ctes(V.SUBSTITUTE)) + "SELECT dataset_index, slot, match_original, match_final, substituted FROM routed",
)
def prepare_match(spark, sf):
    return V.prepare_match(_slots(spark, sf), V.SUBSTITUTE).select(
        "dataset_index", "slot", "match_original", "match_final", "substituted"
    )


_SECTION = "coalesce(md5(complete_lean_proof_section), '-')"
_NORMALIZED = f"""SELECT dataset_index, sample_id // 8 AS run, sample_id % 8 + 1 AS slot, least(8, cnt - 8 * (sample_id // 8)) AS n,
    concat('merged_proof_', sample_id % 8 + 1) AS field, proof, md5(concat(completion, '|', coalesce(reasoning, '-'), '|', {_SECTION})) AS carried FROM
  (SELECT s.*, f.completion, f.reasoning, f.complete_lean_proof_section, count(*) OVER (PARTITION BY dataset_index) AS cnt
    FROM slots s JOIN (SELECT dataset_index, sample_id, completion, reasoning, complete_lean_proof_section FROM fields) f USING (dataset_index, sample_id)) s
  UNION ALL SELECT dataset_index, -1, 1, 1, 'merged_proof', formal_statement, NULL FROM problems WHERE dataset_index % 3 = 0
  UNION ALL SELECT dataset_index, -1, i, dataset_index % 3 + 1, concat('merged_proof_', i), CASE i WHEN 1 THEN formal_statement WHEN 2 THEN name END,
    CASE WHEN i < 3 THEN md5(concat(CASE i WHEN 1 THEN name ELSE split END, '|-|-')) END FROM problems, range(1, 4) r(i) WHERE dataset_index % 3 > 0 AND i <= dataset_index % 3 + 1"""


@query("normalize_slots", D.ctes(**slots_ctes()) + _NORMALIZED)
def normalize_slots(spark, sf):
    """Nested records of several samples beside records with one ready proof and such with two or three, of which the third is missing."""
    nested = X.nest_samples(X.add_sample_fields(I.samples(spark, sf)).withColumn("run", F.expr(RUN).cast("bigint"))).select(
        "dataset_index", "run", "formal_statement", "samples"
    )
    index, run = F.col("dataset_index"), F.lit(-1).cast("bigint").alias("run")
    problems = I.problems(spark, sf)
    ready = problems.filter(index % 3 == 0).select("dataset_index", run, "formal_statement", F.col("formal_statement").alias("merged_proof"))
    wide = problems.filter(index % 3 > 0).select(
        "dataset_index", run, "formal_statement", (index % 3 + 1).alias("n"), F.col("formal_statement").alias("merged_proof_1"),
        F.col("name").alias("merged_proof_2"), F.col("name").alias("completion_1"), F.col("split").alias("completion_2"),
    )
    records = nested.unionByName(ready, allowMissingColumns=True).unionByName(wide, allowMissingColumns=True)
    shown = [F.coalesce("reasoning", F.lit("-")), F.coalesce(F.md5("complete_lean_proof_section"), F.lit("-"))]
    carried = F.md5(F.concat(F.col("completion"), F.lit("|"), shown[0], F.lit("|"), shown[1])).alias("carried")
    return V.normalize_slots(records).select("dataset_index", "run", "slot", "n", "field", "proof", carried)


@query(
    "route_proofs",
    D.ctes(**routed_ctes(V.SUBSTITUTE))
    + """SELECT dataset_index, slot, route, CASE route WHEN 'empty' THEN 'merged_proof is null or empty'
        WHEN 'mismatch' THEN 'formal statement does not match proof (statement_match=substitute)' END AS error,
      CASE WHEN route <> 'verify' THEN 0.0::DOUBLE END AS verify_time, CASE WHEN route <> 'verify' THEN false END AS pass, CASE WHEN route = 'mismatch' THEN true END AS statement_match_failed,
      CASE WHEN route = 'mismatch' THEN match_original END AS match_original, CASE WHEN route = 'mismatch' THEN match_final END AS match_final,
      CASE WHEN route = 'mismatch' THEN substituted END AS substituted FROM routed""",
)
def route_proofs(spark, sf):
    """The route of each slot and the verdict of those that fail without the checker."""
    v = F.col("route_verdict")
    return V.route(_slots(spark, sf), V.SUBSTITUTE).select(
        "dataset_index", "slot", "route", v["errors"][0]["data"].alias("error"), v["verify_time"].alias("verify_time"), v["pass"].alias("pass"),
        v["statement_match_failed"].alias("statement_match_failed"), v["formal_statement_match_original"].alias("match_original"),
        v["formal_statement_match"].alias("match_final"), v["formal_statement_substituted"].alias("substituted"),
    )


@query(
    "route_proofs_counts",
    D.ctes(**routed_ctes(V.SUBSTITUTE))
    + """SELECT CAST(count_if(route = 'empty') AS BIGINT) AS null_count, CAST(count_if(substituted AND route <> 'empty') AS BIGINT) AS substitution_count,
      CAST(count_if(route = 'mismatch') AS BIGINT) AS mismatch_count, CAST(count_if(route = 'verify') AS BIGINT) AS verify_count FROM routed""",
)
def route_proofs_counts(spark, sf):
    return V.route_counts(V.route(_slots(spark, sf), V.SUBSTITUTE))


_NO_MSG = "CAST([] AS JSON[])"
_MESSAGES = "coalesce(CAST(json_extract(raw_json, '$.messages') AS JSON[]), CAST([] AS JSON[]))"


def _of(severity: str) -> str:
    return f"list_filter(msgs, lambda m: json_extract_string(m, '$.severity') = '{severity}')"


_ODD = "coalesce(json_type(m, '$.data'), 'NULL') <> 'VARCHAR'"
_SPOILS = "contains(json_extract_string(m, '$.data'), 'declaration uses ''sorry''') OR contains(json_extract_string(m, '$.data'), 'failed')"

VERDICT_CTES = {
    "raw_verdicts": I.VERDICTS,
    "objects": "SELECT *, CASE WHEN json_valid(raw_json) THEN json_type(raw_json) = 'OBJECT' ELSE false END AS is_object FROM raw_verdicts",
    "listed": "SELECT *, CASE WHEN is_object THEN coalesce(json_type(raw_json, '$.messages'), 'ARRAY') = 'ARRAY' ELSE false END AS is_listed FROM objects",
    "valid": f"SELECT *, CASE WHEN is_listed THEN {_MESSAGES} ELSE {_NO_MSG} END AS msgs, "
    "CASE WHEN is_listed THEN coalesce(json_array_length(raw_json, '$.sorries'), 0) ELSE 0 END AS n_sorries FROM listed",
    "opened": f"SELECT *, list_filter({_of('warning')}, lambda m: {_ODD} OR {_SPOILS}) AS telling FROM valid",
    "judged": "SELECT *, is_listed AND len(list_filter(msgs, lambda m: json_type(m, '$.severity') IS NULL)) = 0 "
    f"AND NOT (len({_of('error')}) = 0 AND n_sorries = 0 AND len(list_filter(telling[1:1], lambda m: {_ODD})) > 0) AS ok FROM opened",
    "counted": f"SELECT *, len({_of('error')}) AS n_errors, len({_of('warning')}) AS n_warnings, len({_of('info')}) AS n_infos, "
    "len(telling) AS n_spoil FROM judged",
    "verdicts": "SELECT *, coalesce(ok AND n_errors = 0, false) AS pass, coalesce(ok AND n_errors = 0 AND n_sorries = 0 AND n_spoil = 0, false) AS complete, "
    "CASE WHEN NOT ok THEN 'json.decoder.JSONDecodeError' END AS system_errors FROM counted",
}


def _verdicts(spark, sf):
    return V.parse_verdict(I.verdicts(spark, sf), "raw_json")


@query(
    "parse_verdict",
    D.ctes(**VERDICT_CTES) + "SELECT doc_id, pass, complete, system_errors, CASE WHEN ok THEN n_errors END AS n_errors, CASE WHEN ok THEN n_warnings END AS n_warnings, "
    "CASE WHEN ok THEN n_infos END AS n_infos, CASE WHEN ok THEN CAST(n_sorries AS BIGINT) END AS n_sorries FROM verdicts",
)
def parse_verdict(spark, sf):
    sizes = [F.size(c).cast("bigint").alias(f"n_{c}") for c in ("errors", "warnings", "infos", "sorries")]
    df = _verdicts(spark, sf).withColumn("ok", F.col("system_errors").isNull())
    return df.select("doc_id", "pass", "complete", "system_errors", *[F.when(F.col("ok"), s).alias(n) for s, n in zip(sizes, ("n_errors", "n_warnings", "n_infos", "n_sorries"))])


_SYSTEM = """SELECT doc_id, doc_id % 3 = 0 AS pass, doc_id % 6 = 0 AS complete, CASE doc_id % 5 WHEN 1 THEN concat('subprocess.TimeoutExpired: ', text)
  WHEN 2 THEN concat(text, ' json.decoder.JSONDecodeError: x') WHEN 3 THEN text END AS system_errors FROM documents"""


@query(
    "error_class",
    D.ctes(v=_SYSTEM)
    + """, c AS (SELECT *, CASE WHEN system_errors IS NULL THEN 'none' WHEN contains(system_errors, 'TimeoutExpired') THEN 'timeout'
      WHEN contains(system_errors, 'json.decoder.JSONDecodeError') THEN 'json_error' ELSE 'other' END AS kind FROM v)
    SELECT count(*) AS total, CAST(count_if(pass AND complete) AS BIGINT) AS n_verified, CAST(count_if(kind = 'timeout') AS BIGINT) AS n_timeout,
      CAST(count_if(kind = 'json_error') AS BIGINT) AS n_json_error, CAST(count_if(kind = 'other') AS BIGINT) AS n_error,
      round(100 * count_if(pass AND complete) / count(*), 6) AS verified_ratio, round(100 * count_if(kind = 'timeout') / count(*), 6) AS timeout_ratio,
      round(100 * count_if(kind = 'json_error') / count(*), 6) AS json_error_ratio, round(100 * count_if(kind = 'other') / count(*), 6) AS error_ratio FROM c""",
)
def error_class(spark, sf):
    return V.error_report(I.run(spark, sf, _SYSTEM))


def _checked(spark, sf, mode=V.EXACT):
    """Routed slots with the checker's verdicts and the failures of the routing."""
    routed = V.route(_slots(spark, sf), mode).select("dataset_index", "sample_id", "slot", "route")
    verdicts = _verdicts(spark, sf).select("dataset_index", "sample_id", "pass", "complete")
    to_check = V.join_verdicts(routed, verdicts, ["dataset_index", "sample_id"])
    return V.failed_routes_as_verdicts(to_check)


_CHECKED = {
    **routed_ctes(V.EXACT),
    **VERDICT_CTES,
    "checked": """SELECT r.dataset_index, r.slot, r.route, CASE WHEN r.route <> 'verify' THEN false ELSE v.pass END AS pass,
      CASE WHEN r.route <> 'verify' THEN false ELSE v.complete END AS complete
      FROM routed r LEFT JOIN verdicts v ON r.dataset_index = v.dataset_index AND r.sample_id = v.sample_id""",
}


@query("join_verdicts", D.ctes(**_CHECKED) + "SELECT dataset_index, slot, route, pass, complete FROM checked")
def join_verdicts(spark, sf):
    return _checked(spark, sf).select("dataset_index", "slot", "route", "pass", "complete")


_STATS = """SELECT slot, count(*) AS total, CAST(count_if(route <> 'empty') AS BIGINT) AS valid,
  CAST(count_if(route <> 'empty' AND pass IS NOT NULL) AS BIGINT) AS verified, CAST(count_if(route <> 'empty' AND complete) AS BIGINT) AS complete,
  CAST(count_if(route <> 'empty' AND pass) AS BIGINT) AS pass, CAST(count_if(route <> 'empty' AND NOT pass) AS BIGINT) AS error,
  CAST(count_if(route = 'empty') AS BIGINT) AS null_count FROM checked"""


@query("slot_stats", D.ctes(**_CHECKED) + _STATS + " GROUP BY ROLLUP (slot)")
def slot_stats(spark, sf):
    return V.slot_stats(_checked(spark, sf))


@query(
    "pass_at_n",
    D.ctes(**_CHECKED)
    + """, p AS (SELECT dataset_index, max(slot) AS n, bool_or(complete) AS c, bool_or(pass) AS q FROM checked GROUP BY dataset_index),
    a AS (SELECT p.* FROM problems LEFT JOIN p USING (dataset_index))
    SELECT max(n) AS n, count(*) AS total_problems, CAST(count_if(c) AS BIGINT) AS problems_with_complete, CAST(count_if(q) AS BIGINT) AS problems_with_pass,
      round(100 * count_if(c) / count(*), 6) AS complete_pct, round(100 * count_if(q) / count(*), 6) AS pass_pct FROM a""",
)
def pass_at_n(spark, sf):
    """Complete@n and Pass@n from raw completions: extract, match, route, join, report."""
    return V.pass_at_n(_checked(spark, sf), problems=I.problems(spark, sf))


@query(
    "verified_ratio",
    D.ctes(**_CHECKED)
    + "SELECT count(pass) AS total_count, CAST(count_if(complete) AS BIGINT) AS verified_count, round(count_if(complete) / count(pass), 6) AS ratio FROM checked",
)
def verified_ratio(spark, sf):
    return V.verified_ratio(_checked(spark, sf))


@query(
    "coverage_stats",
    D.ctes(**_CHECKED, t=_STATS.replace("SELECT slot, ", "SELECT "))
    + """SELECT total AS expected, valid, verified, complete, round(100 * valid / total, 6) AS valid_pct, round(100 * null_count / total, 6) AS null_pct,
      round(100 * verified / valid, 6) AS verified_pct, round(100 * complete / verified, 6) AS complete_pct, round(100 * pass / verified, 6) AS pass_pct,
      round(100 * error / verified, 6) AS error_pct FROM t""",
)
def coverage_stats(spark, sf):
    stats = V.slot_stats(_checked(spark, sf))
    return V.coverage(stats.filter(F.col("slot").isNull()))
