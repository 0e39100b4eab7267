"""Queries on text extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions import arrays as A
from evalweave.operators import extract as X
from evalweave.plans import duck as D
from evalweave.plans import inputs as I
from evalweave.plans.registry import query

M = D.lit(X.PROOF_MARKER)
_FENCE = f"```lean(?:4)?[{D.WS_CLASS}]*\\n"
_FULL = (
    f"(regexp_matches({D.strip('completion')}, '^(theorem|lemma|example|def)\\b') OR (starts_with({D.strip('completion')}, 'import ')"
    f" AND regexp_matches({D.strip('completion')}, '(?m)^[{D.WS_CLASS}]*(theorem|lemma|example|def)\\b')))"
)
_LAST = D.after_last("completion", X.PROOF_MARKER)


def _d_header(statement: str, stop: str) -> str:
    """Header lines of a statement; `stop` tests a stripped line s for a declaration."""
    lines = f"string_split(regexp_replace(coalesce({statement}, ''), '\\r\\n?', chr(10), 'g'), chr(10))"
    s = D.strip("l")
    is_header = f"(starts_with({s}, 'import ') OR starts_with({s}, 'set_option ') OR starts_with({s}, 'open '))"
    is_stop = f"(NOT {is_header} AND (starts_with({s}, '/--') OR {stop.format(s=s)}))"
    first = f"coalesce(list_position(list_transform({lines}, lambda l: {is_stop}), true), len({lines}) + 1)"
    kept = f"list_filter({lines}[1:{first} - 1], lambda l: {is_header})"
    return f"coalesce({D.strip_or_null(f'array_to_string({kept}, chr(10))')}, {D.lit(X.DEFAULT_HEADER)})"


_STOP = {
    X.AUTOREGRESSIVE: "(starts_with({s}, 'theorem ') OR starts_with({s}, 'lemma ') OR starts_with({s}, 'example') OR starts_with({s}, 'def '))",
    X.DIFFUSION: "regexp_matches({s}, '^(theorem|lemma|example|def)\\b')",
}


def _d_ensure(src: str, header: str) -> str:
    s = D.strip(src)
    whole = D.strip(f"{header} || chr(10) || chr(10) || {s}")
    return f"CASE WHEN starts_with({s}, 'import ') THEN {s} ELSE {whole} END"


def extracted(variant: str = X.AUTOREGRESSIVE) -> dict[str, str]:
    """CTEs from the tables to all extracted fields of every sample."""
    no_block = (
        f"CASE WHEN len(blocks) > 0 THEN last_block ELSE coalesce(last_block, whole) END"
        if variant == X.AUTOREGRESSIVE
        else "coalesce(last_block, whole)"
    )
    return {
        "problems": I.PROBLEMS,
        "completions": I.COMPLETIONS,
        "joined": "SELECT c.*, p.name, p.informal_prefix, p.formal_statement, p.split FROM completions c JOIN problems p USING (dataset_index)",
        "marked": f"""SELECT *, {D.strip("coalesce(formal_statement, '')")} AS prompt_formal_statement,
            contains(completion, {M}) AS marked, CASE WHEN contains(completion, {M}) THEN concat({M}, {_LAST}) ELSE completion END AS search_text
            FROM joined""",
        "blocked": f"""SELECT *, regexp_extract_all(search_text, '{_FENCE}(.*?)```', 1, 'is') AS blocks,
            string_split_regex(search_text, '(?i){_FENCE}') AS pieces,
            CASE WHEN {_FULL} THEN {D.strip('completion')} END AS whole FROM marked""",
        "lasted": f"""SELECT *, CASE WHEN len(blocks) > 0 THEN {D.strip_or_null('blocks[-1]')}
            WHEN len(pieces) > 1 THEN {D.strip_or_null('pieces[-1]')} END AS last_block FROM blocked""",
        "sourced": f"SELECT *, {no_block} AS lean_code_block, {_d_header('prompt_formal_statement', _STOP[variant])} AS header FROM lasted",
        "fields": f"""SELECT *, CASE WHEN marked THEN {D.strip_or_null(f'substr(completion, 1, length(completion) - length({M}) - length({_LAST}))')}
              ELSE {D.strip_or_null('completion')} END AS reasoning,
            CASE WHEN marked THEN {D.strip_or_null('search_text')} END AS complete_lean_proof_section,
            {_d_ensure('coalesce(lean_code_block, completion)', 'header')} AS candidate_source,
            CASE WHEN lean_code_block IS NOT NULL THEN {_d_ensure('lean_code_block', 'header')} END AS verification_source
            FROM sourced""",
    }


def _sql(select: str, variant: str = X.AUTOREGRESSIVE) -> str:
    return D.ctes(**extracted(variant)) + select


_ID = ("dataset_index", "sample_id")
_C = "completion"


@query("extract_reasoning", _sql("SELECT dataset_index, sample_id, reasoning FROM fields"))
def extract_reasoning(spark, sf):
    return I.completions(spark, sf).select(*_ID, X.reasoning(F.col(_C)).alias("reasoning"))


@query("extract_proof_section", _sql("SELECT dataset_index, sample_id, complete_lean_proof_section AS section FROM fields"))
def extract_proof_section(spark, sf):
    return I.completions(spark, sf).select(*_ID, X.proof_section(F.col(_C)).alias("section"))


@query("extract_last_block", _sql("SELECT dataset_index, sample_id, last_block FROM lasted"))
def extract_last_block(spark, sf):
    return X.with_last_block(I.completions(spark, sf), "completion", "last_block").select(*_ID, "last_block")


@query("extract_source", _sql("SELECT dataset_index, sample_id, lean_code_block AS source FROM sourced"))
def extract_source(spark, sf):
    return X.with_source(I.completions(spark, sf), "completion", "source").select(*_ID, "source")


@query("extract_source_diffusion", _sql("SELECT dataset_index, sample_id, lean_code_block AS source FROM sourced", X.DIFFUSION))
def extract_source_diffusion(spark, sf):
    return X.with_source(I.completions(spark, sf), "completion", "source", X.DIFFUSION).select(*_ID, "source")


_HEADERS = D.ctes(problems=I.PROBLEMS) + (
    f"SELECT dataset_index, {_d_header('formal_statement', _STOP[X.AUTOREGRESSIVE])} AS header,"
    f" {_d_header('formal_statement', _STOP[X.DIFFUSION])} AS header_diffusion FROM problems"
)


@query("extract_header", _HEADERS)
def extract_header(spark, sf):
    s = F.col("formal_statement")
    return I.problems(spark, sf).select(
        "dataset_index", X.header(s).alias("header"), X.header(s, X.DIFFUSION).alias("header_diffusion")
    )


@query("ensure_header", _sql(f"SELECT dataset_index, sample_id, {_d_ensure('completion', 'header')} AS with_header FROM sourced"))
def ensure_header(spark, sf):
    df = I.samples(spark, sf).withColumn("header", X.header(F.col("formal_statement")))
    return df.select(*_ID, X.ensure_header(F.col(_C), F.col("header")).alias("with_header"))


@query("candidate_source", _sql("SELECT dataset_index, sample_id, candidate_source FROM fields"))
def candidate_source(spark, sf):
    return X.add_sample_fields(I.samples(spark, sf)).select(*_ID, "candidate_source")


@query("verification_source", _sql("SELECT dataset_index, sample_id, verification_source FROM fields", X.DIFFUSION))
def verification_source(spark, sf):
    return X.add_sample_fields(I.samples(spark, sf), X.DIFFUSION).select(*_ID, "verification_source")


# Each problem has been sampled in runs of 8.
RUN = "floor(sample_id / 8)"
_NESTED = f"""SELECT dataset_index, run, any_value(name) AS name, any_value(prompt_formal_statement) AS prompt_formal_statement,
  count(*) AS num_samples,
  string_agg(concat(sample_id, ':', md5(completion), ':', coalesce(md5(reasoning), '-'), ':', coalesce(md5(lean_code_block), '-'), ':',
     coalesce(md5(verification_source), '-'), ':', md5(candidate_source), ':', coalesce(md5(complete_lean_proof_section), '-')), ';' ORDER BY sample_id) AS samples
  FROM (SELECT *, CAST({RUN} AS BIGINT) AS run FROM fields) f GROUP BY dataset_index, run"""


@query("sample_records", _sql(_NESTED))
def sample_records(spark, sf):
    """Nested records, one for each run of a problem, each field shown by its md5."""
    records = X.nest_samples(X.add_sample_fields(I.samples(spark, sf)).withColumn("run", F.expr(RUN).cast("bigint")))

    def show(s):
        parts = [
            F.coalesce(F.md5(s[f]), F.lit("-"))
            for f in ("completion", "reasoning", "lean_code_block", "verification_source", "candidate_source", "complete_lean_proof_section")
        ]
        return F.concat_ws(":", s["sample_id"].cast("string"), *parts)

    return records.select(
        "dataset_index", "run", "name", "prompt_formal_statement", "num_samples",
        F.array_join(F.transform("samples", show), ";").alias("samples"),
    )


_LOOKS = f"""SELECT dataset_index, sample_id, (s <> '' AND NOT ({" OR ".join(f"contains(s, {D.lit(m)})" for m in X.NOT_LEAN_MARKERS)})
  AND (starts_with(s, 'import ') OR {" OR ".join(f"contains(s, {D.lit(m)})" for m in X.LEAN_MARKERS)})) AS looks
  FROM (SELECT *, {D.strip("candidate_source")} AS s FROM fields) f"""


@query("looks_like_lean", _sql(_LOOKS))
def looks_like_lean(spark, sf):
    df = X.add_sample_fields(I.samples(spark, sf))
    return df.select(*_ID, X.looks_like_lean(F.col("candidate_source")).alias("looks"))


_LABELLED = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('Formal proof:', chr(10), text) WHEN 1 THEN concat('Formalisation: ', text) ELSE text END AS content
  FROM documents"""
_LABEL_SQL = (
    D.ctes(labelled=_LABELLED)
    + f""", s AS (SELECT *, CASE WHEN starts_with(content, 'Formal proof:') THEN {D.strip('substr(content, 14)')}
      WHEN starts_with(content, 'Formalisation:') THEN {D.strip('substr(content, 15)')} ELSE content END AS stripped FROM labelled)
    SELECT doc_id, md5(stripped) AS content_md5, length(stripped) <> length(content) AS removed FROM s"""
)


@query("strip_label_prefix", _LABEL_SQL)
def strip_label_prefix(spark, sf):
    df = I.run(spark, sf, _LABELLED).withColumn("stripped", X.strip_label(F.col("content")))
    return df.select("doc_id", F.md5("stripped").alias("content_md5"), (F.length("stripped") != F.length("content")).alias("removed"))


@query(
    "strip_label_prefix_counts",
    D.ctes(labelled=_LABELLED)
    + """SELECT count_if(starts_with(content, 'Formal proof:') OR starts_with(content, 'Formalisation:')) AS n_removed,
    count(content) AS total_content, round(count_if(starts_with(content, 'Formal proof:') OR starts_with(content, 'Formalisation:')) / count(content), 6) AS ratio FROM labelled""",
)
def strip_label_prefix_counts(spark, sf):
    out = X.label_counts(I.run(spark, sf, _LABELLED), "content")
    return out.withColumn("ratio", F.round("ratio", 6))


# Left-padded sequences whose prompt is a third of the words; ids 10 and 11 stop.
_SEQ = f"""SELECT doc_id, CAST(prompt_len AS INT) AS prompt_len, list_concat(list_transform(range(0, doc_id % 4), lambda z: 0), input_ids) AS seq,
  input_ids FROM ({I.D_TOKEN_ROWS}) t"""
EOS, EOT = 300, 700


def _sequences(spark, sf):
    pad = A.fill(0, F.col("doc_id") % 4)
    return I.token_rows(spark, sf).withColumn("seq", F.concat(pad, F.col("input_ids")))


@query(
    "trim_generated",
    D.ctes(s=_SEQ)
    + f""", c AS (SELECT doc_id, input_ids[prompt_len + 1:] AS canvas FROM s)
    SELECT doc_id, len(canvas) AS canvas_len, {D.ints(f"canvas[1:coalesce(list_position(list_transform(canvas, lambda x: x IN ({EOS}, {EOT})), true), len(canvas) + 1) - 1]")} AS output_ids FROM c""",
)
def trim_generated(spark, sf):
    df = _sequences(spark, sf)
    canvas, out = X.generated_part(F.col("seq"), F.col("prompt_len"), 0, EOS, EOT)
    return df.select("doc_id", F.size(canvas).cast("bigint").alias("canvas_len"), A.join_ints(out).alias("output_ids"))


@query(
    "trim_infill",
    D.ctes(s=_SEQ)
    + f""", c AS (SELECT doc_id, list_filter(input_ids, lambda x, i: (doc_id + i) % 3 <> 0) AS infill FROM s)
    SELECT doc_id, {D.ints(f"infill[1:coalesce(list_position(list_transform(infill, lambda x: x IN ({EOS}, {EOT})), true), len(infill) + 1) - 1]")} AS infill_ids FROM c""",
)
def trim_infill(spark, sf):
    """The prompt holds the mask id (2) at two of three positions."""
    df = _sequences(spark, sf).withColumn(
        "prompt", F.transform("input_ids", lambda x, i: F.when((F.col("doc_id") + i + 1) % 3 != 0, 2).otherwise(x))
    )
    out = X.infill_part(F.col("seq"), F.col("prompt"), 2, 0, EOS, EOT)
    return df.select("doc_id", A.join_ints(out).alias("infill_ids"))


STOPS = ("\n", ". ", ", ")
_CUT = "text"
for _s in STOPS:
    _CUT = D.before_first(_CUT, _s)


@query("cut_stop_sequences", f"SELECT doc_id, {_CUT} AS answer FROM documents")
def cut_stop_sequences(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", X.cut_at_stops(F.col("text"), STOPS).alias("answer"))
