"""A training corpus in five steps: toxic documents go, near copies go but one, documents
that hold benchmark items go, personal data is masked, texts become token ids.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again
as the next one's docs. All but the last keep the columns of docs; rows with NULL or empty
texts, repeated rows, extra columns and empty tables are handled as each stage says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import bpe, toxicity
from evalweave.llm.disclosure import personal_spans, sanitise
from evalweave.llm.jaccard import near_duplicates
from evalweave.llm.latent import leaks
from evalweave.sources.scratch import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; those without text stay."""
    score = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(score(F.col("text").cast("string")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; of repeated rows
    one. Documents without text have no copies.
    """
    gone = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns).dropDuplicates(["doc_id", "text"])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(materialize(found), "doc_id", "left_anti").select(docs.columns)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; n_chars follows the new text."""
    clean = personal_spans(docs).withColumn("text", sanitise(F.col("text"), F.col("spans")))
    changed = F.size("spans") > 0
    values = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text")).otherwise(F.col("row.n_chars")).cast("bigint")}
    return clean.select(*(values[c].alias(c) if c in values else F.col(f"row.`{c}`") for c in docs.columns))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether decoding gives the text back."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    whole = docs.select("doc_id", "lang", "source", "text", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    rows = bpe.encode(whole, path, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "bytes"))
    return rows.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), (F.col("decoded") == F.col("bytes")).alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", mask_personal),
    ("bpe", to_tokens),
]

#: The label model, the latent space and the byte-pair merges have no SQL form; tests hold the
#: stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
