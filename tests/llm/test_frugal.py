"""Arrow batches of the pipeline's stages stay small, whatever the texts' lengths."""

import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalweave.llm import bpe, latent, toxicity
from evalweave.llm.frugal import KEY
from evalweave.llm.jaccard import near_duplicates


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "n"])


def _largest(spark):
    """Bytes of the largest batch that a task gets of 2,000 texts of 10,000 bytes, and the number of texts."""
    texts = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("0123456789"), 1000).alias("text"))
    return tuple(texts.mapInArrow(_sizes, "size bigint, n bigint").agg(F.max("size"), F.sum("n")).first())


STAGES = {
    "toxicity": lambda d, e: toxicity.fit(d, e.select(F.col("item_id").alias("doc_id"), F.lit(0).alias("toxic"))),
    "jaccard_join": lambda d, e: near_duplicates(d),
    "decontamination": lambda d, e: latent.leaks(d, e),
    "bpe": lambda d, e: bpe.encode(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
}


@pytest.fixture
def unset(spark):
    spark.conf.unset(KEY)
    yield spark
    spark.conf.unset(KEY)


@pytest.mark.parametrize("stage", STAGES)
def test_tasks_get_small_batches(unset, stage):
    docs = unset.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    STAGES[stage](docs, unset.createDataFrame([], "item_id bigint, text string"))
    size, rows = _largest(unset)
    assert size < 2_000_000 and rows == 2000


def test_a_size_that_the_session_sets_stays(unset):
    unset.conf.set(KEY, "4m")
    bpe.encode(unset.createDataFrame([], "doc_id bigint, text string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert unset.conf.get(KEY) == "4m" and 3_000_000 < _largest(unset)[0] < 6_000_000
