"""The operators over their whole tables, as the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import bpe
from evalweave.llm.alignment import align, with_counts
from evalweave.llm.disclosure import PATTERNS, digest, personal_spans
from evalweave.llm.hilbert import hilbert_shards
from evalweave.llm.hostgraph import judge_urls
from evalweave.llm.html_main import extract_main
from evalweave.llm.jaccard import near_duplicates
from evalweave.llm.latent import leaks
from evalweave.llm.licenses import license_scan
from evalweave.llm.packing import pack
from evalweave.llm.spelling import counted_words, spelling_variants
from evalweave.llm.topk import top_k
from evalweave.llm.toxicity import toxicity
from evalweave.sources.scratch import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_jaccard_join")
def op9(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_byte_bpe")
def op10(spark, sf_dir):
    """Ids and decoded bytes of every text, as digests."""
    rows = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_license_scan")
def op2(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).drop("places")


@query("op1_html_wrapper")
def op1(spark, sf_dir):
    return extract_main(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query("op3_toxicity")
def op3(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op8_block_topk",
    """
    WITH rows AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
      FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10""",
)
def op8(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op4_hilbert_shards")
def op4(spark, sf_dir):
    return hilbert_shards(table(spark, sf_dir, "documents"))


@query("op5_host_propagation")
def op5(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


@query("op6_disclosure")
def op6(spark, sf_dir):
    rows = personal_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return rows.select("doc_id", *(count(k) for k in PATTERNS), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


@query("op7_latent_leaks")
def op7(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    return spelling_variants(counted_words(table(spark, sf_dir, "documents")))


@query("op12_concat_pack")
def op12(spark, sf_dir):
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op13_token_alignment")
def op13(spark, sf_dir):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = align(table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    stored = materialize(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"))
    return with_counts(stored).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
