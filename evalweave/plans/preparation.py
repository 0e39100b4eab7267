"""Queries on sources, projections, selections and merges."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyspark.sql import functions as F

from evalweave.functions import text as T
from evalweave.functions.ordering import prefix_totals
from evalweave.operators import merge as G
from evalweave.operators import project as P
from evalweave.operators import select as S
from evalweave.plans import duck as D
from evalweave.plans import inputs as I
from evalweave.plans.registry import query
from evalweave.sources import growing
from evalweave.sources import mixture as X
from evalweave.sources import readers as R
from evalweave.sources import sinks as W
from evalweave.sources.scratch import scratch_dir
from evalweave.streaming import samples as ST

# ---- derived source tables -------------------------------------------------

INSTRUCT = """SELECT doc_id AS row_id, concat(' ', source, chr(10)) AS instruction,
  CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '  ' ELSE concat(text, chr(10)) END AS input,
  CASE WHEN doc_id % 10 = 9 THEN NULL ELSE concat(chr(10), text, ' ') END AS output, lang FROM documents"""
REASONING = """SELECT doc_id, source AS question, CASE WHEN doc_id % 4 = 0 THEN array() ELSE array(text, lang) END AS trajectories, text AS attempt FROM documents"""
WORD_PROBLEMS = """SELECT doc_id, text AS question, CASE WHEN doc_id % 5 = 0 THEN text
  WHEN doc_id % 5 = 1 THEN concat(text, '####', doc_id, ' #### tail') ELSE concat(text, ' #### ', doc_id, chr(10)) END AS answer FROM documents"""
SPLIT_DOCS = """SELECT doc_id, text, lang, CASE WHEN doc_id % 10 = 0 THEN 'test_sft' WHEN doc_id % 10 = 1 THEN 'test_gen' ELSE 'train_sft' END AS split FROM documents"""
_RANK_RECORD = """concat('{"dataset_index": ', CASE WHEN doc_id % 13 = 0 THEN '"x"' ELSE concat('', CAST(floor(doc_id * 3 / 4) AS BIGINT)) END,
    ', "generation_metrics": ', CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE concat('{"output_tokens": ', doc_id, ', "wall_seconds": 0.5, "own": 1, "batch_metrics": [{"output_tokens": ', doc_id, '}]}') END,
    ', "num_samples": 2, "samples": [{"sample_id": 0, "raw_completion": "', lang, '", "completion": "', body, '"}',
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat(', {"sample_id": 1, "completion": "', lang, '"}') END, ']}')"""
RANK_LINES = f"""SELECT doc_id % 4 + 1 AS file_no, CAST(floor(doc_id / 4) AS BIGINT) AS line_no,
  CASE WHEN doc_id % 7 = 0 THEN substr(rec, 1, length(rec) - 9) ELSE rec END AS line
  FROM (SELECT doc_id, {_RANK_RECORD} AS rec FROM
    (SELECT doc_id, lang, replace(replace(text, '"', ''''), chr(10), ' ') AS body FROM documents) b) r"""


def q(spark, sf, sql):
    return I.run(spark, sf, sql)


def docs(spark, sf):
    return I.table(spark, sf, "documents")


# ---- sources ----------------------------------------------------------------

_SPLIT_PROBLEMS = D.ctes(problems=I.PROBLEMS)


@query("src_named_split", _SPLIT_PROBLEMS + "SELECT dataset_index, name FROM problems WHERE split = 'test'")
def src_named_split(spark, sf):
    """The source has only `train`; the wanted split is a logical column of it."""
    rows = I.problems(spark, sf).withColumn("hf_split", F.lit("train"))
    return S.named_split(rows, "test", ["train"]).select("dataset_index", "name")


_VALID = """SELECT file_no, line_no, line, json_valid(line) AS ok FROM lines"""
_COMPLETE = """SELECT file_no, line_no, CAST(json_extract(line, '$.dataset_index') AS BIGINT) AS dataset_index, line FROM
  (SELECT * FROM valid WHERE ok) v WHERE json_type(line, '$.dataset_index') IN ('BIGINT', 'UBIGINT')
  AND CAST(json_extract(line, '$.num_samples') AS BIGINT) = 2 AND json_array_length(line, '$.samples') = 2"""
RANK_CTES = {"lines": RANK_LINES, "valid": _VALID, "complete": _COMPLETE}


def _complete(spark, sf):
    return R.parse_records(q(spark, sf, RANK_LINES), "line", 2)


def _first_completion():
    return F.md5(F.col("samples")[0]["completion"]).alias("completion_md5")


_D_FIRST = "md5(json_extract_string(line, '$.samples[0].completion')) AS completion_md5"


@query(
    "src_json_tolerant",
    D.ctes(**RANK_CTES)
    + f"""SELECT file_no, line_no, dataset_index, {_D_FIRST}, json_extract_string(line, '$.samples[0].raw_completion') AS raw_completion,
      CAST(json_extract(line, '$.generation_metrics.output_tokens') AS BIGINT) AS output_tokens, CAST(json_extract(line, '$.generation_metrics.wall_seconds') AS DOUBLE) AS wall_seconds,
      CAST(json_extract(line, '$.generation_metrics.batch_metrics[0].output_tokens') AS BIGINT) AS batch_tokens FROM complete""",
)
def src_json_tolerant(spark, sf):
    metrics = F.col("generation_metrics")
    return _complete(spark, sf).select(
        "file_no", "line_no", "dataset_index", _first_completion(), F.col("samples")[0]["raw_completion"].alias("raw_completion"),
        metrics["output_tokens"].alias("output_tokens"), metrics["wall_seconds"].alias("wall_seconds"), F.get(metrics["batch_metrics"], F.lit(0))["output_tokens"].alias("batch_tokens"),
    )


def _write_lines(spark, sf):
    """The rank files on disk, one folder per rank."""
    folder = scratch_dir(spark)
    q(spark, sf, RANK_LINES).select("line", "file_no").write.mode("overwrite").partitionBy("file_no").text(f"{folder}/ranks")
    return folder


@query("src_json_records", D.ctes(**RANK_CTES) + f"SELECT dataset_index, {_D_FIRST}, CAST(json_extract(line, '$.generation_metrics.output_tokens') AS BIGINT) AS output_tokens FROM complete")
def src_json_records(spark, sf):
    """Records written as JSON lines and read back with the stated schema."""
    path = f"{scratch_dir(spark)}/records.jsonl"
    W.write_jsonl(_complete(spark, sf).select("dataset_index", "num_samples", "samples", "generation_metrics"), path)
    return R.json_records(spark, path).select("dataset_index", _first_completion(), F.col("generation_metrics.output_tokens").alias("output_tokens"))


@query("src_latest_file", "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id % 2 = 1")
def src_latest_file(spark, sf):
    """Of two results of different age and a newer one that is not finished, the newest finished one is read.

    Each result is a folder of JSON lines, written by as many tasks as read the table.
    """
    folder = f"{scratch_dir(spark)}/results"
    for age, (name, rest) in enumerate((("old.json", 0), ("new.json", 1), ("later.part.json", 0))):
        rows = docs(spark, sf).select("doc_id", "text").filter(F.col("doc_id") % 2 == rest)
        rows.write.json(f"{folder}/{name}")
        time.sleep(0.02 * (age < 2))  # times in a listing are whole milliseconds
    return spark.read.schema("doc_id BIGINT, text STRING").json(R.latest_file(spark, folder, "*.json")).select("doc_id", F.md5("text").alias("text_md5"))


_SUDOKU = """SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN '0' ELSE '1' END, CASE WHEN (doc_id + 1) % 3 = 0 THEN '0' ELSE '2' END,
  CASE WHEN (doc_id + 2) % 3 = 0 THEN '0' ELSE '3' END, '0341221434321') AS puzzle, '1234341221434321' AS solution FROM documents"""


@query("src_csv_strings", f"SELECT puzzle AS \"Puzzle\", solution AS \"Solution\", count(*) AS n FROM ({_SUDOKU}) s GROUP BY 1, 2")
def src_csv_strings(spark, sf):
    path = f"{scratch_dir(spark)}/sudoku"
    q(spark, sf, _SUDOKU).select(F.col("puzzle").alias("Puzzle"), F.col("solution").alias("Solution")).write.csv(path, header=True)
    return R.csv_strings(spark, path, ["Puzzle", "Solution"]).groupBy("Puzzle", "Solution").agg(F.count("*").alias("n"))


@query("src_preprocessed", f"SELECT split, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM ({SPLIT_DOCS}) s GROUP BY split")
def src_preprocessed(spark, sf):
    path = f"{scratch_dir(spark)}/prepared"
    W.write_prepared(q(spark, sf, SPLIT_DOCS), path)
    return R.preprocessed(spark, path).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def _loaders(spark, sf):
    def chats(options):
        pairs = q(spark, sf, I.FIRST_TURNS)
        rows = pairs.select(F.col("conv_id").alias("row_id"), P.messages_pair(F.col("instruction"), F.col("output")).alias("messages"))
        return rows.withColumn("split", F.lit("train")), ["train"]

    def prose(options):
        rows = q(spark, sf, SPLIT_DOCS).withColumn("lang_name", F.col("lang"))
        if "lang" in options:
            rows = rows.filter(F.col("lang") == options["lang"])
        rows = P.rename_splits(rows, {"train_sft": "train", "test_sft": "test"})
        messages = P.messages_pair(F.col("lang_name"), F.col("text")).alias("messages")
        return rows.select(F.col("doc_id").alias("row_id"), "split", messages), ["train", "test"]

    return {"chats": chats, "prose": prose}


MIXTURE = "chats[train:300,test:100] + prose[lang:en,train:2_000] | prose[lang:de]"
_D_CHATS = "(SELECT conv_id AS row_id, instruction AS ask, output AS reply FROM first_turns)"
_D_PROSE = "(SELECT doc_id AS row_id, CASE split WHEN 'train_sft' THEN 'train' ELSE 'test' END AS split, lang AS ask, text AS reply FROM split_docs WHERE split <> 'test_gen')"
_HEAD = "row_number() OVER (PARTITION BY split ORDER BY row_id)"


@query(
    "src_mixture",
    D.ctes(first_turns=I.FIRST_TURNS, split_docs=SPLIT_DOCS)
    + f"""SELECT 'chats' AS source_name, s.split, row_id, ask, md5(reply) AS reply_md5 FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS rn FROM {_D_CHATS} c) c
      JOIN (SELECT 'train' AS split, 300 AS n UNION ALL SELECT 'test', 100) s ON rn <= n
    UNION ALL SELECT 'prose', split, row_id, ask, md5(reply) FROM (SELECT *, {_HEAD} AS rn FROM {_D_PROSE} p WHERE ask = 'en') e WHERE split = 'test' OR rn <= 2000
    UNION ALL SELECT 'prose', split, row_id, ask, md5(reply) FROM {_D_PROSE} p WHERE ask = 'de'""",
)
def src_mixture(spark, sf):
    rows = X.load_mixture(X.specs_of(MIXTURE), _loaders(spark, sf), "row_id")
    return rows.select(
        "source_name", "split", "row_id", F.col("messages")[0]["content"].alias("ask"), F.md5(F.col("messages")[1]["content"]).alias("reply_md5")
    )


@query("src_all_configs", "SELECT concat('by_', lang) AS config, doc_id, md5(text) AS text_md5 FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')")
def src_all_configs(spark, sf):
    configs = {f"by_{c}": (lambda c=c: docs(spark, sf).filter(F.col("lang") == c)) for c in ("en", "fr", "de", "es")}
    return X.load_all_configs(configs).select("config", "doc_id", F.md5("text").alias("text_md5"))


_MERGED = """SELECT dataset_index, arg_max(file_no, file_no * 1000000000 + line_no) AS file_no, arg_max(line_no, file_no * 1000000000 + line_no) AS line_no,
  arg_max(line, file_no * 1000000000 + line_no) AS line FROM complete GROUP BY dataset_index"""


SEGMENT = 1 << 14  # lines of a rank's file before it goes on in the next one


def _write_rank_files(spark, sf, folder: str, share: float, segment: int = SEGMENT) -> None:
    """The files of each rank, as far as its process has come: that share of its lines and half of the next.

    A rank goes on in a new file after so many lines, named in order. A task writes a whole file
    anew under another name and renames it, so it can run again.
    """
    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = growing.opened(folder)
        name, n = None, 0
        with ExitStack() as last:
            for batch in rows:
                for file_no, part, line, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if name != (file_no, part):
                        last.close()
                        system.create_dir(root)
                        path = f"{root}/rank{file_no:05d}-{part:08d}.jsonl"
                        last.callback(system.move, path + ".part", path)  # runs when the file is closed
                        file = last.enter_context(system.open_output_stream(path + ".part"))
                        name, n = (file_no, part), n + 1
                    file.write(f"{line}\n".encode() if whole else line.encode())
        yield pa.RecordBatch.from_pydict({"n": [n]})

    lines = q(spark, sf, RANK_LINES)
    ends = lines.groupBy("file_no").agg(F.floor(F.max("line_no") * share).alias("_last"))  # one row a rank
    rows = lines.join(F.broadcast(ends), "file_no").filter(F.col("line_no") <= F.col("_last"))
    whole = (F.col("line_no") < F.col("_last")) | F.lit(share >= 1)
    text = F.when(whole, F.col("line")).otherwise(F.expr("substr(line, 1, length(line) div 2)"))
    part = F.floor(F.col("line_no") / segment).alias("part")
    dealt = rows.select("file_no", part, text.alias("line"), whole.alias("whole"), "line_no").repartition("file_no", "part")
    ordered = dealt.sortWithinPartitions("file_no", "part", "line_no")
    ordered.drop("line_no").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


@query("src_stream_samples", D.ctes(**RANK_CTES, merged=_MERGED) + f"SELECT dataset_index, file_no, {_D_FIRST} FROM merged")
def src_stream_samples(spark, sf):
    """Rank files, the stream's merge of what they hold, more lines in the same files, and the merge of those."""
    folder = scratch_dir(spark)
    for share in (0.5, 1.0):
        _write_rank_files(spark, sf, f"{folder}/ranks", share)
        ST.collect_samples(ST.sample_stream(spark, f"{folder}/ranks", 2), f"{folder}/table", f"{folder}/checkpoint", buckets=8)
    rows = ST.merged_samples(spark, f"{folder}/table")
    file_no = F.regexp_extract("file", r"rank0*(\d+)", 1).cast("bigint")
    return rows.select("dataset_index", file_no.alias("file_no"), _first_completion())


@query("src_file_jobs", D.ctes(**RANK_CTES) + f"SELECT concat('out', file_no) AS output, dataset_index, {_D_FIRST} FROM complete")
def src_file_jobs(spark, sf):
    folder = _write_lines(spark, sf)
    jobs = R.file_jobs([f"{folder}/ranks/file_no={i}" for i in range(1, 5)], [f"{folder}/out{i}" for i in range(1, 5)])
    rows = (
        spark.read.schema(f"{R.RECORD}, {R.CORRUPT} STRING").option("columnNameOfCorruptRecord", R.CORRUPT).json([a for a, _ in jobs])
        .withColumn("source", F.element_at(F.split("_metadata.file_path", "/"), -2))
    )
    complete = G.complete_records(rows.filter(F.col(R.CORRUPT).isNull()), 2)
    W.write_jobs(complete, "source", {a.rpartition("/")[2]: b for a, b in jobs})
    written = [R.json_records(spark, f"{b}/*.json").withColumn("output", F.lit(b.rpartition("/")[2])) for _, b in jobs]
    return G.concat_by_split(*written).select("output", "dataset_index", _first_completion())


@query("sink_jsonl", D.ctes(**RANK_CTES) + f"SELECT dataset_index, {_D_FIRST} FROM complete")
def sink_jsonl(spark, sf):
    path = f"{scratch_dir(spark)}/samples.jsonl"
    W.write_jsonl(_complete(spark, sf).select("dataset_index", "num_samples", "samples"), path)
    return R.json_records(spark, path).select("dataset_index", _first_completion())


@query("sink_prepared", f"SELECT split, doc_id FROM ({SPLIT_DOCS}) s")
def sink_prepared(spark, sf):
    path = W.prepared_path(scratch_dir(spark), 1024, True, True)
    W.write_prepared(q(spark, sf, SPLIT_DOCS), path, {"doc_id"})
    return spark.read.parquet(path).select("split", "doc_id")


# ---- projections ------------------------------------------------------------


@query("row_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS dataset_index FROM documents")
def row_index(spark, sf):
    return P.row_index(docs(spark, sf).select("doc_id"), "doc_id")


_PROMPT = [D.lit(p) for p in P.PROOF_PROMPT.split("{}")]


@query("prompt_proof", _SPLIT_PROBLEMS + f"SELECT dataset_index, 'user' AS role, concat({_PROMPT[0]}, {D.strip('formal_statement')}, {_PROMPT[1]}) AS content FROM problems")
def prompt_proof(spark, sf):
    df = I.problems(spark, sf).withColumn("prompt", P.user_prompt(P.proof_prompt(F.col("formal_statement"))))
    return df.select("dataset_index", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"))


def _two(df, *ids, col="messages"):
    return df.select(
        *ids, F.size(col).cast("bigint").alias("n"), F.col(col)[0]["content"].alias("ask"), F.col(col)[1]["content"].alias("reply")
    )


_ASK = f"CASE WHEN {D.strip('coalesce(input, {0})').format(chr(39) * 2)} <> '' THEN concat({D.strip('instruction')}, chr(10), chr(10), {D.strip('input')}) ELSE {D.strip('instruction')} END"


@query("to_messages_instruct", D.ctes(rows=INSTRUCT) + f"SELECT row_id, 2 AS n, {_ASK} AS ask, {D.strip('coalesce(output, {0})').format(chr(39) * 2)} AS reply FROM rows")
def to_messages_instruct(spark, sf):
    df = q(spark, sf, INSTRUCT)
    return _two(df.withColumn("messages", P.messages_instruct(F.col("instruction"), F.col("input"), F.col("output"))), "row_id")


@query("to_messages_pair", D.ctes(rows=I.FIRST_TURNS) + "SELECT conv_id, 2 AS n, instruction AS ask, output AS reply FROM rows")
def to_messages_pair(spark, sf):
    df = q(spark, sf, I.FIRST_TURNS)
    return _two(df.withColumn("messages", P.messages_pair(F.col("instruction"), F.col("output"))), "conv_id")


@query(
    "to_messages_reasoning",
    "SELECT doc_id, 2 AS n, source AS ask, text AS reply, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE text END AS reasoning FROM documents",
)
def to_messages_reasoning(spark, sf):
    df = q(spark, sf, REASONING).withColumn("m", P.messages_reasoning(F.col("question"), F.col("trajectories"), F.col("attempt")))
    return _two(df.withColumn("reasoning", F.col("m")[1]["reasoning_content"]), "doc_id", "reasoning", col="m")


_D_FIRST_TURN = f"""WITH u AS (SELECT conv_id, min(turn) AS t, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id),
  a AS (SELECT c.conv_id, any_value(prompt) AS prompt, arg_min(text, turn) AS response FROM conversations c JOIN u ON c.conv_id = u.conv_id
    WHERE role = 'assistant' AND turn > t AND text IS NOT NULL GROUP BY c.conv_id)
  SELECT conv_id, {D.strip('prompt')} AS prompt, {D.strip('response')} AS response FROM a WHERE {D.strip('prompt')} <> '' AND {D.strip('response')} <> ''"""


@query("first_turn", _D_FIRST_TURN)
def first_turn(spark, sf):
    return P.first_turn(I.table(spark, sf, "conversations")).select("conv_id", "prompt", "response")


@query("first_turn_nested", _D_FIRST_TURN)
def first_turn_nested(spark, sf):
    rows = P.messages_of(I.table(spark, sf, "conversations"))
    found = rows.withColumn("f", P.first_turn_nested(F.col("messages"))).filter(F.col("f").isNotNull())
    return found.select("conv_id", "f.prompt", "f.response")


@query("rename_splits", f"SELECT doc_id, CASE split WHEN 'train_sft' THEN 'train' ELSE 'test' END AS split FROM ({SPLIT_DOCS}) s WHERE split <> 'test_gen'")
def rename_splits(spark, sf):
    return P.rename_splits(q(spark, sf, SPLIT_DOCS), {"train_sft": "train", "test_sft": "test"}).select("doc_id", "split")


def _prompt_only(df, *cols):
    return df.select(*cols, F.col("prompt")[0]["content"].alias("content"))


@query(
    "prompt_gsm8k",
    D.ctes(rows=WORD_PROBLEMS)
    + f"SELECT doc_id, concat({D.lit(P.SYSTEM_PROMPT)}, chr(10), chr(10), question) AS content, CASE WHEN contains(answer, '####') THEN {D.strip(chr(115) + 'tring_split(answer, {0})[2]').format(D.lit('####'))} END AS answer FROM rows",
)
def prompt_gsm8k(spark, sf):
    return _prompt_only(P.prompt_gsm8k(q(spark, sf, WORD_PROBLEMS)), "doc_id", "answer")


def _countdown(spark, sf):
    nums = F.array(*[(1 + F.col("doc_id") % n).cast("int") for n in (9, 7, 5)])
    nums = F.when(F.col("doc_id") % 4 == 3, F.concat(nums, F.array(F.lit(6)))).otherwise(nums)
    return docs(spark, sf).select("doc_id", nums.alias("nums"), (F.col("doc_id") % 9 + 3).alias("target"))


_CD = [D.lit(p) for p in P.COUNTDOWN_PROMPT.split("{}")]


@query(
    "prompt_countdown",
    f"SELECT doc_id, doc_id % 9 + 3 AS target, concat({_CD[0]}, '[', 1 + doc_id % 9, ', ', 1 + doc_id % 7, ', ', 1 + doc_id % 5, ']', {_CD[1]}, doc_id % 9 + 3, {_CD[2]}) AS content FROM documents WHERE doc_id % 4 <> 3",
)
def prompt_countdown(spark, sf):
    return _prompt_only(P.prompt_countdown(_countdown(spark, sf)), "doc_id", "target")


@query("prompt_sudoku", f"SELECT doc_id, solution, concat({D.lit(P.SUDOKU_PROMPT)}, chr(10), chr(10), 'Solve the following Sudoku puzzle: ', puzzle, chr(10)) AS content FROM ({_SUDOKU}) s")
def prompt_sudoku(spark, sf):
    df = q(spark, sf, _SUDOKU).withColumnsRenamed({"puzzle": "Puzzle", "solution": "Solution"})
    return _prompt_only(P.prompt_sudoku(df), "doc_id", "solution")


@query("prompt_math", f"SELECT doc_id, lang AS answer, concat({D.lit(P.MATH_PROMPT)}, text) AS content FROM documents")
def prompt_math(spark, sf):
    df = docs(spark, sf).select("doc_id", F.col("text").alias("problem"), F.col("lang").alias("solution"))
    return _prompt_only(P.prompt_math(df), "doc_id", "answer")


_ORDER = "concat(md5(concat('42|', doc_id)), '|', doc_id)"


def _d_split(fraction: str, src: str = "documents") -> str:
    return f"SELECT *, CASE WHEN row_number() OVER (ORDER BY {_ORDER}) <= ceil({fraction} * (SELECT count(*) FROM {src})) THEN 'test' ELSE 'train' END AS split FROM {src}"


@query("prompt_code", D.ctes(s=_d_split("0.1")) + f"SELECT doc_id, lang AS solution, source AS tests, concat({D.lit(P.CODE_PROMPT)}, text) AS content FROM s WHERE split = 'train'")
def prompt_code(spark, sf):
    kept = S.split_fraction(docs(spark, sf), "doc_id", 0.1).filter(F.col("split") == "train")
    df = kept.select("doc_id", F.col("text").alias("question"), F.col("lang").alias("solution"), F.col("source").alias("test"))
    return _prompt_only(P.prompt_code(df), "doc_id", "answer.solution", "answer.tests")


_TURN = f"concat('<|start_header_id|>', role, '<|end_header_id|>', chr(10), chr(10), {D.strip('text')}, '<|eot_id|>')"
_SECTION = f"""CASE WHEN role = 'system' AND rn = 1 THEN concat('[SYS]', chr(10), {D.strip('text')}, chr(10), '[/SYS]', chr(10), chr(10))
  WHEN role = 'user' THEN concat('[Question]', chr(10), {D.strip('text')}, chr(10), '[/Question]', chr(10), chr(10))
  WHEN role = 'assistant' THEN concat('[Answer]', chr(10), {D.strip('text')}, chr(10), '[/Answer]', chr(10), chr(10)) ELSE '' END"""


@query(
    "render_chat",
    f"""SELECT conv_id, concat('<s>', string_agg({_TURN}, '' ORDER BY turn), CASE WHEN arg_max(role, turn) <> 'assistant' THEN concat('<|start_header_id|>assistant<|end_header_id|>', chr(10), chr(10)) ELSE '' END) AS header_text,
      concat(string_agg({_SECTION}, '' ORDER BY turn), CASE WHEN arg_max(role, turn) <> 'assistant' THEN concat('[Answer]', chr(10)) ELSE '' END) AS section_text
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) c GROUP BY conv_id""",
)
def render_chat(spark, sf):
    m = F.col("messages")
    return P.messages_of(I.table(spark, sf, "conversations")).select(
        "conv_id", P.render_header(m, True, "<s>").alias("header_text"), P.render_sections(m, True).alias("section_text")
    )


@query("drop_keep_columns", "SELECT doc_id, lang FROM documents")
def drop_keep_columns(spark, sf):
    return P.keep_columns(docs(spark, sf), {"doc_id", "lang", "labels"})


# ---- filters, limits, splits, shards ------------------------------------------


@query("filter_lang_substr", D.ctes(s=_d_split("0.05")) + "SELECT doc_id, split FROM s WHERE contains(text, 'the')")
def filter_lang_substr(spark, sf):
    split = S.split_fraction(docs(spark, sf), "doc_id", 0.05)
    rows = split.withColumn("messages", P.messages_pair(F.col("lang"), F.col("text")))
    return S.assistant_mentions(rows, "the").select("doc_id", "split")


@query(
    "filter_lang_column",
    """SELECT 'synthetic_qa' AS config, doc_id FROM documents WHERE lang = 'en' AND source < 'src2' UNION ALL
    SELECT 'algorithmic_corpus', doc_id FROM documents WHERE lang = 'en' AND source >= 'src2'""",
)
def filter_lang_column(spark, sf):
    qa = docs(spark, sf).filter(F.col("source") < "src2").withColumnRenamed("lang", "program_lang")
    code = docs(spark, sf).filter(F.col("source") >= "src2")
    configs = {
        "synthetic_qa": lambda: S.in_language(qa, "synthetic_qa", "en").select("doc_id"),
        "algorithmic_corpus": lambda: S.in_language(code, "algorithmic_corpus", "en").select("doc_id"),
    }
    return X.load_all_configs(configs).select("config", "doc_id")


LIMITS = {"train_sft": 500, "test_sft": 30}


@query(
    "limit_split",
    f"SELECT doc_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS rn FROM ({SPLIT_DOCS}) s) r WHERE split = 'test_gen' OR rn <= CASE split WHEN 'train_sft' THEN 500 ELSE 30 END",
)
def limit_split(spark, sf):
    rows = q(spark, sf, SPLIT_DOCS).select("doc_id", "split")
    return S.limit_split(rows, LIMITS, "doc_id", ["train_sft", "test_sft", "test_gen"])


@query(
    "limit_split_overlap",
    "SELECT doc_id, s.split FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) d JOIN (SELECT 'train' AS split, 700 AS n UNION ALL SELECT 'test', 150) s ON rn <= n",
)
def limit_split_overlap(spark, sf):
    rows = docs(spark, sf).select("doc_id").withColumn("split", F.lit("train"))
    return S.limit_split(rows, {"train": 700, "test": 150}, "doc_id", ["train"]).select("doc_id", "split")


@query(
    "limit_split_stream",
    "SELECT doc_id, CASE WHEN rn <= 150 THEN 'test' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) d WHERE rn <= 850",
)
def limit_split_stream(spark, sf):
    rows = docs(spark, sf).select("doc_id").withColumn("split", F.lit("train"))
    return S.limit_split_stream(rows, {"train": 700, "test": 150}, "doc_id", ["train"]).select("doc_id", "split")


@query("split_fraction", D.ctes(s=_d_split("0.05")) + "SELECT doc_id, split FROM s")
def split_fraction(spark, sf):
    return S.split_fraction(docs(spark, sf).select("doc_id"), "doc_id", 0.05)


@query("select_prefix", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) d WHERE rn <= n // 2")
def select_prefix(spark, sf):
    return S.select_prefix(docs(spark, sf).select("doc_id"), "doc_id", half=True)


@query(
    "shard_contiguous",
    "SELECT doc_id, i AS shard_index FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) d, range(1, 8) r(i) WHERE p >= n * (i - 1) // 7 AND p < n * i // 7",
)
def shard_contiguous(spark, sf):
    return S.with_shards(docs(spark, sf).select("doc_id"), "doc_id", 7)


_DONE = "SELECT doc_id AS dataset_index FROM documents WHERE doc_id % 3 = 0"


@query("assign_round_robin", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS rank FROM documents WHERE doc_id % 3 <> 0")
def assign_round_robin(spark, sf):
    pending = S.resume_pending(docs(spark, sf).select("doc_id"), q(spark, sf, "SELECT doc_id FROM documents WHERE doc_id % 3 = 0"), "doc_id")
    return S.assign_round_robin(pending, "doc_id", 4)


@query(
    "resume_pending",
    "SELECT doc_id AS dataset_index, rank FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS rank FROM documents WHERE doc_id % 3 <> 0) p WHERE NOT (doc_id % 5 = 1 AND rank = 2)",
)
def resume_pending(spark, sf):
    """Done in the main file: every third; done by rank 2: every fifth of its own."""
    problems = docs(spark, sf).select(F.col("doc_id").alias("dataset_index"))
    by_rank = q(spark, sf, "SELECT CAST(2 AS BIGINT) AS rank, doc_id AS dataset_index FROM documents WHERE doc_id % 5 = 1")
    return S.resume_pending_ranks(problems, q(spark, sf, _DONE), by_rank, 4)


@query("filter_max_tokens", D.ctes(t=I.D_TOKEN_ROWS) + "SELECT doc_id, CAST(len(input_ids) AS BIGINT) AS n_tokens FROM t WHERE len(input_ids) <= 256")
def filter_max_tokens(spark, sf):
    return S.max_tokens(I.token_rows(spark, sf), 256).select("doc_id", F.size("input_ids").cast("bigint").alias("n_tokens"))


@query("filter_prompt_fits", D.ctes(t=I.D_TOKEN_ROWS) + "SELECT doc_id, prompt_len FROM t WHERE CASE WHEN doc_id % 6 = 0 THEN NULL ELSE prompt_len END <= 64")
def filter_prompt_fits(spark, sf):
    rows = I.token_rows(spark, sf).withColumn("prompt_len", F.when(F.col("doc_id") % 6 != 0, F.col("prompt_len")))
    return S.prompt_fits(rows, 64).select("doc_id", "prompt_len")


# ---- merges -------------------------------------------------------------------


@query("concat_by_split", f"SELECT split, doc_id AS row_id, md5(text) AS text_md5, lang FROM ({SPLIT_DOCS}) s UNION ALL SELECT 'train_sft', conv_id, md5(text), NULL FROM conversations WHERE role = 'user'")
def concat_by_split(spark, sf):
    a = q(spark, sf, SPLIT_DOCS).select("split", F.col("doc_id").alias("row_id"), F.md5("text").alias("text_md5"), "lang")
    turns = I.table(spark, sf, "conversations").filter(F.col("role") == "user")
    b = turns.select(F.lit("train_sft").alias("split"), F.col("conv_id").alias("row_id"), F.md5("text").alias("text_md5"))
    return G.concat_by_split(a, b)


@query("merge_rank_outputs", D.ctes(**RANK_CTES, merged=_MERGED) + f"SELECT dataset_index, file_no, line_no, {_D_FIRST} FROM merged")
def merge_rank_outputs(spark, sf):
    return G.merge_rank_outputs(_complete(spark, sf)).select("dataset_index", "file_no", "line_no", _first_completion())


@query(
    "rank_progress",
    D.ctes(**RANK_CTES)
    + """SELECT t.rank, target, coalesce(done, 0) AS done, greatest(target - coalesce(done, 0), 0) AS missing FROM
    (SELECT file_no AS rank, count(*) AS target FROM lines GROUP BY file_no) t LEFT JOIN (SELECT file_no AS rank, count(*) AS done FROM complete GROUP BY file_no) d ON t.rank = d.rank""",
)
def rank_progress(spark, sf):
    targets = q(spark, sf, RANK_LINES).groupBy(F.col("file_no").alias("rank")).agg(F.count("*").alias("target"))
    return G.rank_progress(_complete(spark, sf).withColumnRenamed("file_no", "rank"), targets)


# ---- joins ----------------------------------------------------------------------


@query(
    "join_outputs",
    D.ctes(problems=I.PROBLEMS, completions=I.COMPLETIONS)
    + """SELECT dataset_index, name, doc_id, 0 AS sample_id, md5(completion) AS completion_md5 FROM problems JOIN completions USING (dataset_index)
    UNION ALL SELECT dataset_index, name, doc_id, 1, md5(concat(completion, k)) FROM problems JOIN completions USING (dataset_index) WHERE k > 4""",
)
def join_outputs(spark, sf):
    """Runs of one or two completions."""
    first, second = F.array("completion"), F.array("completion", F.concat("completion", F.col("k").cast("string")))
    outputs = I.completions(spark, sf).select(
        "dataset_index", "doc_id", F.when(F.col("k") > 4, second).otherwise(first).alias("completions")
    )
    out = G.join_outputs(I.problems(spark, sf).select("dataset_index", "name"), outputs)
    return out.select("dataset_index", "name", "doc_id", "sample_id", F.md5("completion").alias("completion_md5"))
