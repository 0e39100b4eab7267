"""Inputs that queries derive from the given tables.

The tables hold prose, no Lean, no answer tags and no tokens. Each statement
below wraps their whole rows and whole texts into the shapes the operators
read. Spark and the check engine run the same text where both know its
functions; the few that differ stand side by side.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions import arrays as A
from evalweave.functions import text as T

# Schemas are stated, so that opening a table starts no job to read file footers.
TABLES = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}

_PROBLEM_COUNT = "(SELECT count(*) FROM benchmark)"

PROBLEMS = """
SELECT item_id AS dataset_index, concat('thm_', item_id) AS name, text AS informal_prefix,
  CASE WHEN item_id % 5 = 0 THEN 'valid' ELSE 'test' END AS split, decl,
  CASE item_id % 3
    WHEN 0 THEN concat('import Mathlib', chr(10), 'open Real', chr(10), chr(10), '/-- ', text, ' -/', chr(10),
                       decl, ' := by', chr(10), '  sorry')
    WHEN 1 THEN concat(chr(10), '  ', decl, ' :=  by', chr(10), '  sorry', chr(10))
    ELSE concat('import Mathlib', chr(13), chr(10), 'set_option maxHeartbeats 400', chr(13), chr(10), '/-- ', text,
                ' -/', chr(13), chr(10), decl, ' := by sorry') END AS formal_statement
FROM (SELECT item_id, text, concat('theorem thm_', item_id, ' (n : Nat) : n + ', item_id, ' = ', item_id, ' + n') AS decl
      FROM benchmark) b
"""

# One completion per document: marker and closed fence, two fences, open fence,
# prose only, blank block after a bare theorem, wrong statement, own imports,
# bare theorem, two markers, blank block before an open fence.
COMPLETIONS = f"""
SELECT i AS dataset_index, sample_id, doc_id, k, CASE k
  WHEN 0 THEN concat(plan, m, o, good, c)
  WHEN 1 THEN concat(plan, chr(10), o, bad, c, ' then ', o, good, c)
  WHEN 2 THEN concat(plan, m, o, good)
  WHEN 3 THEN plan
  WHEN 4 THEN concat(good, m, o, ' ', c)
  WHEN 5 THEN concat(plan, m, o, bad, c)
  WHEN 6 THEN concat(plan, m, o, 'import Mathlib', chr(10), good, c)
  WHEN 7 THEN good
  WHEN 8 THEN concat(plan, m, o, bad, c, m, o, good, c)
  ELSE concat(plan, m, o, c, chr(10), o, good) END AS completion
FROM (SELECT *, concat('theorem thm_', i, ' (n : Nat) : n + ', i, ' = ', i, ' + n := by', chr(10), '  omega') AS good,
    concat('theorem other (n : Nat) : n + ', i, ' = n := by', chr(10), '  simp') AS bad,
    concat('```lean4', chr(10)) AS o, concat(chr(10), '```') AS c,
    concat(chr(10), '### Complete Lean 4 Proof', chr(10)) AS m
  FROM (SELECT doc_id, doc_id % {_PROBLEM_COUNT} AS i, text AS plan,
      CAST(floor(doc_id / {_PROBLEM_COUNT}) AS BIGINT) AS sample_id,
      (doc_id + CAST(floor(doc_id / {_PROBLEM_COUNT}) AS BIGINT)) % 10 AS k FROM documents) d) s
"""

VERDICTS = f"""
SELECT doc_id, doc_id % {_PROBLEM_COUNT} AS dataset_index,
  CAST(floor(doc_id / {_PROBLEM_COUNT}) AS BIGINT) AS sample_id, CASE doc_id % 17
  WHEN 7 THEN '{{"messages":null}}'
  WHEN 8 THEN '{{"messages":[{{"data":"no severity"}}]}}'
  WHEN 9 THEN '{{"messages":[{{"severity":"warning","data":null}}]}}'
  WHEN 10 THEN '{{"messages":[{{"severity":"warning","data":5}}]}}'
  WHEN 11 THEN '[{{"env":0}}]'
  WHEN 12 THEN '{{"sorries":null,"messages":[{{"severity":"error","data":"e"}},{{"severity":"warning"}}]}}'
  WHEN 13 THEN '{{"messages":[{{"severity":"warning","data":"failed"}},{{"severity":"warning","data":7}}]}}'
  WHEN 14 THEN '{{"messages":{{"severity":"info"}}}}'
  WHEN 15 THEN 'null'
  WHEN 2 THEN '{{"messages":[{{"severity":"error","data":"unsolved goals"}}]}}'
  WHEN 3 THEN '{{"messages":[{{"severity":"warning","data":"declaration uses ''sorry''"}}]}}'
  WHEN 4 THEN '{{"messages":[{{"severity":"warning","data":"linter failed"}},{{"severity":"info","data":"x"}}]}}'
  WHEN 5 THEN '{{"sorries":[{{"goal":"g"}}],"messages":[]}}'
  WHEN 6 THEN '{{"messages":[{{"severity":"err'
  ELSE '{{"env":0}}' END AS raw_json FROM documents
"""

# Well-formed tags, loose tags, boxed, none, arithmetic, digit string, trailing
# text, both forms of a box; the document text is the reasoning.
ROLLOUTS = f"""
SELECT doc_id, doc_id % {_PROBLEM_COUNT} AS group_id, CAST(floor(doc_id / {_PROBLEM_COUNT}) AS BIGINT) AS gen_id,
  concat('', doc_id % 5) AS truth, CASE doc_id % 9
  WHEN 0 THEN concat('<reasoning>', chr(10), text, chr(10), '</reasoning>', chr(10), '<answer>', chr(10), doc_id % 5, chr(10), '</answer>', chr(10))
  WHEN 1 THEN concat('<reasoning>', text, '</reasoning> <answer>', doc_id % 3, '</answer> tail')
  WHEN 2 THEN concat(text, '<answer>', chr(92), 'boxed{{', chr(92), 'frac{{1}}{{', 1 + doc_id % 4, '}}}}</answer>')
  WHEN 3 THEN text
  WHEN 4 THEN '<answer>2*4-3</answer>'
  WHEN 5 THEN concat('<answer>', substr('1234341221434321', 1, CAST(10 + doc_id % 8 AS INT)), '</answer>')
  WHEN 6 THEN concat('<reasoning>', chr(10), text, chr(10), '</reasoning>', chr(10), '<answer>', chr(10), doc_id % 5, chr(10), '</answer>', chr(10), text)
  WHEN 7 THEN concat(text, ' so ', chr(92), 'boxed ', doc_id % 4, '$ and <answer>', doc_id % 4, '</answer>', chr(10), '</answer>', chr(10))
  ELSE concat(text, chr(92), 'fbox{{', doc_id % 4, '}} open', chr(10), '<answer>', chr(10)) END AS completion FROM documents
"""

FORWARD_CALLS = f"""
SELECT doc_id AS call_id, doc_id % {_PROBLEM_COUNT} AS dataset_index, doc_id % 6 AS batch_id,
  1 + doc_id % 4 AS batch_size, 16 + length(text) AS query_len,
  64 + 2 * length(text) AS kv_len, doc_id % 3 = 0 AS has_past, doc_id % 3 = 1 AS use_cache FROM documents
"""

FIRST_TURNS = """
SELECT u.conv_id, u.text AS instruction, a.text AS output FROM
  (SELECT conv_id, min_by(text, turn) AS text, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id) u
  JOIN (SELECT conv_id, min_by(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id) a
  ON u.conv_id = a.conv_id
"""


#: A session may ask for the key tables to be dealt out by their key, over so many tasks. The small test
#: tables are one row group each, which one task would read; data in many files needs no such step.
SPREAD = "spark.evalweave.spreadInputs"
KEYS = {"documents": "doc_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as it is stored, or spread as the session's SPREAD setting says."""
    df = spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get(SPREAD, None)
    return df.repartition(int(tasks), KEYS[name]) if tasks and name in KEYS else df


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the statements above on the tables it names."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", sql)}
    text = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b{t}\b", "{" + t + "}", text)
    text = text.replace("\\", "\\\\")
    return spark.sql(text, **used)


def problems(spark, sf):
    return run(spark, sf, PROBLEMS)


def completions(spark, sf):
    return run(spark, sf, COMPLETIONS)


def samples(spark, sf):
    """Completions beside their problems."""
    p = problems(spark, sf).select("dataset_index", "name", "informal_prefix", "formal_statement", "split")
    return completions(spark, sf).join(p, "dataset_index")


def verdicts(spark, sf):
    return run(spark, sf, VERDICTS)


def rollouts(spark, sf):
    return run(spark, sf, ROLLOUTS)


def forward_calls(spark, sf):
    return run(spark, sf, FORWARD_CALLS)


def word_ids(words: Column) -> Column:
    """A stand-in token id per word, from its first letter and length."""
    return F.transform(
        words, lambda w: (4 + (F.ascii(w).cast("int") * 31 + F.length(w) * 7) % 997).cast("int")
    )


def token_rows(spark, sf):
    """input_ids, labels (prompt third masked) and prompt_len of each document."""
    ids = F.col("input_ids")
    return (
        table(spark, sf, "documents")
        .select("doc_id", word_ids(T.words("text")).alias("input_ids"))
        .withColumn("prompt_len", F.floor(F.size(ids) / 3).cast("int"))
        .withColumn("labels", F.concat(A.fill(-100, F.col("prompt_len")), A.tail_from(ids, F.col("prompt_len"))))
    )


D_WORDS = "list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '')"
D_WORD_IDS = f"list_transform({D_WORDS}, lambda w: CAST(4 + (ascii(w) * 31 + length(w) * 7) % 997 AS INT))"
D_TOKEN_ROWS = f"""
SELECT doc_id, input_ids, prompt_len,
  list_transform(input_ids, lambda x, i: CASE WHEN i <= prompt_len THEN -100 ELSE x END) AS labels
FROM (SELECT doc_id, input_ids, CAST(floor(len(input_ids) / 3) AS INT) AS prompt_len
  FROM (SELECT doc_id, {D_WORD_IDS} AS input_ids FROM documents) a) b
"""
