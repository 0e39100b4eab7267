"""Reasoning, proof section and Lean source out of raw completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import arrays as A
from evalweave.functions import text as T

# The marker, the fence shapes and the header a proof must have.
PROOF_MARKER = "### Complete Lean 4 Proof"
CLOSED_FENCE = rf"(?is)```lean(?:4)?[{T.WS}]*\n(.*?)```"
OPEN_FENCE = rf"(?i)```lean(?:4)?[{T.WS}]*\n"
DECLARATION_LINE = rf"(?Umd)^[{T.WS}]*(theorem|lemma|example|def)\b"
DECLARATION_START = rf"(?U)\A[{T.WS}]*(theorem|lemma|example|def)\b"
DECLARATION_PREFIXES = ("theorem ", "lemma ", "example", "def ")
HEADER_PREFIXES = ("import ", "set_option ", "open ")
DEFAULT_HEADER = """import Mathlib
import Aesop

set_option maxHeartbeats 0

open BigOperators Real Nat Topology Rat"""
NOT_LEAN_MARKERS = ("```", "### ", "<|im_", "<think>", "</think>", "**Problem", "**Approach")
LEAN_MARKERS = ("theorem ", "lemma ", ":= by", "\nby\n", "\n  by\n")
LABEL_PREFIXES = ("Formal proof:", "Formalisation:")

AUTOREGRESSIVE = "autoregressive"
DIFFUSION = "diffusion"


def reasoning(completion: Column) -> Column:
    """Text before the last marker, or the whole text without one."""
    return T.strip_or_null(
        F.when(T.has(completion, PROOF_MARKER), T.before_last(completion, PROOF_MARKER)).otherwise(completion)
    )


def from_marker(completion: Column) -> Column:
    """Text from the last marker on, or the whole text without one."""
    return F.when(
        T.has(completion, PROOF_MARKER),
        F.concat(F.lit(PROOF_MARKER), T.after_last(completion, PROOF_MARKER)),
    ).otherwise(completion)


def proof_section(completion: Column) -> Column:
    return F.when(T.has(completion, PROOF_MARKER), T.strip_or_null(from_marker(completion)))


def with_last_block(df: DataFrame, completion: str, out: str) -> DataFrame:
    """Add the last closed block (blank gives NULL); only without one, the open tail.

    Also adds `_blocks`, the closed blocks, for callers that need to know.
    """
    open_pieces = F.split(F.col("_search"), OPEN_FENCE, -1)
    return (
        df.withColumn("_search", from_marker(F.col(completion)))
        .withColumn("_blocks", F.regexp_extract_all("_search", F.lit(CLOSED_FENCE), F.lit(1)))
        .withColumn("_pieces", F.when(F.size("_blocks") == 0, open_pieces))
        .withColumn(
            out,
            F.when(F.size("_blocks") > 0, T.strip_or_null(F.element_at("_blocks", -1))).when(
                F.size("_pieces") > 1, T.strip_or_null(F.element_at("_pieces", -1))
            ),
        )
        .drop("_search", "_pieces")
    )


def is_full_source(text: Column) -> Column:
    """A text that is Lean itself: it opens with a declaration or with imports."""
    stripped = T.strip(text)
    return F.rlike(stripped, F.lit(DECLARATION_START)) | (
        F.startswith(stripped, F.lit("import ")) & F.rlike(stripped, F.lit(DECLARATION_LINE))
    )


def with_source(df: DataFrame, completion: str, out: str, variant: str = AUTOREGRESSIVE) -> DataFrame:
    """Add the Lean source of a completion.

    Variants differ on a blank closed block: `autoregressive` gives NULL,
    `diffusion` still takes a whole text that is Lean.
    """
    if variant not in (AUTOREGRESSIVE, DIFFUSION):
        raise ValueError(f"unknown variant {variant!r}")
    whole = F.when(is_full_source(F.col(completion)), T.strip(completion))
    if variant == AUTOREGRESSIVE:
        whole = F.when(F.size("_blocks") == 0, whole)
    return (
        with_last_block(df, completion, "_block")
        .withColumn(out, F.coalesce(F.col("_block"), whole))
        .drop("_block", "_blocks")
    )


def header(statement: Column, variant: str = AUTOREGRESSIVE) -> Column:
    """Import, option and open lines above the first doc comment or declaration."""

    def is_header(line: Column) -> Column:
        return T.starts_with_any(T.strip(line), HEADER_PREFIXES)

    def is_stop(line: Column) -> Column:
        s = T.strip(line)
        declares = (
            T.starts_with_any(s, DECLARATION_PREFIXES)
            if variant == AUTOREGRESSIVE
            else F.rlike(s, F.lit(DECLARATION_START))
        )
        return ~is_header(line) & (F.startswith(s, F.lit("/--")) | declares)

    lines = F.split(F.regexp_replace(T.text_or_empty(statement), r"\r\n?", "\n"), "\n", -1)
    above = A.head(lines, F.coalesce(A.first_position(lines, is_stop), F.size(lines)))
    found = T.strip_or_null(F.array_join(F.filter(above, is_header), "\n"))
    return F.coalesce(found, F.lit(DEFAULT_HEADER))


def ensure_header(src: Column, head: Column) -> Column:
    """The source with a header in front, unless it brings its own imports."""
    stripped = T.strip(src)
    return F.when(F.startswith(stripped, F.lit("import ")), stripped).otherwise(
        T.strip(F.concat(head, F.lit("\n\n"), stripped))
    )


def add_sample_fields(df: DataFrame, variant: str = AUTOREGRESSIVE) -> DataFrame:
    """Add all extracted fields to rows with `completion` and `formal_statement`.

    Source and header are made once, in their own step, and used twice.
    """
    completion = F.col("completion")
    found = F.col("lean_code_block")
    return (
        with_source(df, "completion", "lean_code_block", variant)
        .withColumn("prompt_formal_statement", T.strip(T.text_or_empty("formal_statement")))
        .withColumn("_header", header(F.col("prompt_formal_statement"), variant))
        .withColumn("reasoning", reasoning(completion))
        .withColumn("complete_lean_proof_section", proof_section(completion))
        .withColumn("candidate_source", ensure_header(F.coalesce(found, completion), F.col("_header")))
        .withColumn("verification_source", F.when(found.isNotNull(), F.col("candidate_source")))
        .drop("_header")
    )


SAMPLE_FIELDS = (
    "sample_id",
    "completion",
    "reasoning",
    "complete_lean_proof_section",
    "lean_code_block",
    "candidate_source",
    "verification_source",
)
PROBLEM_FIELDS = ("name", "informal_prefix", "formal_statement", "prompt_formal_statement")


def nest_samples(df: DataFrame) -> DataFrame:
    """One record per problem with all its samples, as an ordered array.

    A problem that was sampled in several runs has a record for each: `run` is a column of
    the input then, and a record is as large as the number of samples its run asked for.
    """
    keys = [c for c in ("dataset_index", "run") if c in df.columns]
    return (
        df.groupBy(*keys)
        .agg(
            *[F.any_value(c).alias(c) for c in PROBLEM_FIELDS],
            F.count(F.lit(1)).alias("num_samples"),
            F.sort_array(F.collect_list(F.struct(*SAMPLE_FIELDS))).alias("samples"),
        )
    )


def looks_like_lean(text: Column) -> Column:
    s = T.strip(T.text_or_empty(text))
    return (
        (s != "")
        & ~T.contains_any(s, NOT_LEAN_MARKERS)
        & (F.startswith(s, F.lit("import ")) | T.contains_any(s, LEAN_MARKERS))
    )


def strip_label(content: Column) -> Column:
    """Content without a leading label."""
    out = content
    for p in reversed(LABEL_PREFIXES):
        out = F.when(F.startswith(content, F.lit(p)), T.strip(F.substr(content, F.lit(len(p) + 1)))).otherwise(out)
    return out


def label_counts(df: DataFrame, content: str) -> DataFrame:
    """How many contents carried a label, and their share."""
    labelled = T.starts_with_any(F.col(content), LABEL_PREFIXES)
    return df.agg(
        F.count_if(labelled).alias("n_removed"), F.count(content).alias("total_content")
    ).withColumn(
        "ratio", F.when(F.col("total_content") > 0, F.col("n_removed") / F.col("total_content")).otherwise(0.0)
    )


def generated_part(
    seq: Column,
    prompt_len: Column,
    pad_id: int | None = None,
    eos_id: int | None = None,
    eot_id: int | None = None,
    needs_eos: bool = False,
) -> tuple[Column, Column]:
    """(canvas, trimmed): tokens after the prompt, and those before the first stop id.

    Left padding is dropped first. With `needs_eos` the end-of-turn id counts
    only when an end-of-sequence id is known too.
    """
    if pad_id is not None:
        start = F.coalesce(A.first_position(seq, lambda x: x != pad_id), F.size(seq))
        seq = A.tail_from(seq, start)
    canvas = A.tail_from(seq, prompt_len)
    stops = [i for i in (eos_id, eot_id) if i is not None]
    if not stops or (needs_eos and eos_id is None):
        return canvas, canvas
    end = A.first_position(canvas, lambda x: x.isin(stops))
    return canvas, A.head(canvas, F.coalesce(end, F.size(canvas)))


def infill_part(
    seq: Column, prompt: Column, mask_id: int, pad_id: int | None = None, eos_id: int | None = None, eot_id: int | None = None
) -> Column:
    """Generated tokens at the prompt's masked positions, up to the first stop id."""
    if pad_id is not None:
        start = F.coalesce(A.first_position(seq, lambda x: x != pad_id), F.size(seq))
        seq = A.tail_from(seq, start)
    pairs = F.filter(F.arrays_zip(seq.alias("s"), prompt.alias("p")), lambda z: z["p"] == mask_id)
    infill = F.transform(pairs, lambda z: z["s"])
    if eos_id is None:
        return infill
    stops = [i for i in (eos_id, eot_id) if i is not None]
    end = A.first_position(infill, lambda x: x.isin(stops))
    return A.head(infill, F.coalesce(end, F.size(infill)))


def cut_at_stops(text: Column, stops: tuple[str, ...]) -> Column:
    """Text before each stop string in turn."""
    for s in stops:
        text = T.before_first(text, s)
    return text
