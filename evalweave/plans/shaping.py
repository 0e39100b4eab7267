"""Queries on token rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions import arrays as A
from evalweave.functions import text as T
from evalweave.operators import project as P
from evalweave.operators import tokens as K
from evalweave.plans import duck as D
from evalweave.plans import inputs as I
from evalweave.plans.registry import query

TOK = {"t": I.D_TOKEN_ROWS}
EOS_ID = 300


def ints(c):
    return A.join_ints(F.col(c))


def tokens(spark, sf):
    return I.token_rows(spark, sf)


# ---- vocabulary ----------------------------------------------------------------

VOCAB = """SELECT word, CAST(3 + row_number() OVER (ORDER BY n DESC, word) AS INT) AS id FROM
  (SELECT word, count(*) AS n FROM (SELECT unnest({words}) AS word FROM documents) w GROUP BY word) c""".replace("{words}", I.D_WORDS)


def vocab(spark, sf):
    return K.build_vocab(I.table(spark, sf, "documents").select(T.words("text").alias("w")), "w")


@query("vocabulary", VOCAB)
def vocabulary(spark, sf):
    return vocab(spark, sf)


_ENCODED = """SELECT d.key, array_to_string(list(coalesce(v.id, 3) ORDER BY pos), ',') AS ids FROM
  (SELECT key, unnest(words) AS word, unnest(range(len(words))) AS pos FROM rows) d LEFT JOIN vocab v USING (word) GROUP BY d.key"""


@query(
    "tokens_via_vocab",
    D.ctes(vocab=VOCAB, rows=f"SELECT conv_id * 1000 + turn AS key, {I.D_WORDS} AS words FROM conversations")
    + f"SELECT key // 1000 AS conv_id, key % 1000 AS turn, ids AS input_ids FROM ({_ENCODED}) e",
)
def tokens_via_vocab(spark, sf):
    turns = I.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), T.words("text").alias("w"))
    out = K.encode_words(turns, "key", "w", vocab(spark, sf))
    return out.select(F.expr("key div 1000").alias("conv_id"), (F.col("key") % 1000).alias("turn"), ints("input_ids").alias("input_ids"))


_D_TURN = f"concat('<|start_header_id|>', role, '<|end_header_id|>', chr(10), chr(10), {D.strip('text')}, '<|eot_id|>')"
_CHAT = f"""SELECT conv_id, whole, concat(prompt, CASE WHEN coalesce(prev_role, '') <> 'assistant' THEN concat('<|start_header_id|>assistant<|end_header_id|>', chr(10), chr(10)) ELSE '' END) AS prompt FROM
  (SELECT conv_id, string_agg({_D_TURN}, '' ORDER BY turn) AS whole, coalesce(string_agg({_D_TURN}, '' ORDER BY turn) FILTER (WHERE turn < last_turn), '') AS prompt,
    arg_max(role, turn) FILTER (WHERE turn < last_turn) AS prev_role
   FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations) c GROUP BY conv_id) g"""


def _d_words(x: str) -> str:
    return I.D_WORDS.replace("(text,", f"({x},")


@query(
    "chat_tokens",
    D.ctes(vocab=VOCAB, chat=_CHAT, rows=f"SELECT conv_id AS key, {_d_words('whole')} AS words FROM chat", enc=_ENCODED)
    + f"""SELECT conv_id, ids AS input_ids, CAST(len({_d_words('prompt')}) AS INT) AS prompt_len,
      {D.ints("list_transform(string_split(ids, ','), lambda x, i: CASE WHEN i <= len(" + _d_words('prompt') + ") THEN -100 ELSE CAST(x AS INT) END)")} AS labels
      FROM chat JOIN enc ON conv_id = key""",
)
def chat_tokens(spark, sf):
    chats = P.messages_of(I.table(spark, sf, "conversations"))
    out = K.chat_tokens(chats, "conv_id", vocab(spark, sf))
    return out.select("conv_id", "prompt_len", ints("input_ids").alias("input_ids"), ints("labels").alias("labels"))


# ---- packing and clipping --------------------------------------------------------


@query("append_eos", D.ctes(**TOK) + f"SELECT doc_id, {D.ints(f'CASE WHEN input_ids[-1] = {EOS_ID} THEN input_ids ELSE list_append(input_ids, {EOS_ID}) END')} AS input_ids FROM t")
def append_eos(spark, sf):
    return tokens(spark, sf).select("doc_id", A.join_ints(K.append_eos(F.col("input_ids"), EOS_ID)).alias("input_ids"))


def _d_pack(group: str, drop: bool, length: int = 512) -> str:
    having = f"HAVING count(*) = {length}" if drop else ""
    return D.ctes(**TOK) + f"""SELECT pack_group, chunk, string_agg(tok, ',' ORDER BY p) AS input_ids FROM
      (SELECT pack_group, p // {length} AS chunk, p, CAST(tok AS VARCHAR) AS tok FROM
        (SELECT pack_group, tok, row_number() OVER (PARTITION BY pack_group ORDER BY doc_id, i) - 1 AS p FROM
          (SELECT {group} AS pack_group, doc_id, unnest(ids) AS tok, unnest(range(len(ids))) AS i FROM
            (SELECT doc_id, CASE WHEN input_ids[-1] = 1 THEN input_ids ELSE list_append(input_ids, 1) END AS ids FROM t) e) u) n) c GROUP BY pack_group, chunk {having}"""


@query("pack_sequences", _d_pack("doc_id // 1000", True))
def pack_sequences(spark, sf):
    out = K.pack_sequences(tokens(spark, sf), "doc_id", 512, insert_eos=True)
    return out.select("pack_group", "chunk", ints("input_ids").alias("input_ids"))


@query("pack_sequences_global", _d_pack("0", False))
def pack_sequences_global(spark, sf):
    out = K.pack_sequences(tokens(spark, sf), "doc_id", 512, batch_rows=None, insert_eos=True, drop_tail=False)
    return out.select("pack_group", "chunk", ints("input_ids").alias("input_ids"))


@query(
    "clip_right_left",
    D.ctes(**TOK) + f"SELECT doc_id, {D.ints('input_ids[1:128]')} AS ids, {D.ints('labels[1:128]')} AS labels, 'right' AS side FROM t UNION ALL "
    + f"SELECT doc_id, {D.ints('input_ids[greatest(len(input_ids) - 127, 1):]')}, {D.ints('labels[greatest(len(labels) - 127, 1):]')}, 'left' FROM t",
)
def clip_right_left(spark, sf):
    rows = tokens(spark, sf)
    both = K.clip(rows, 128).withColumn("side", F.lit("right")).union(K.clip(rows, 128, "left").withColumn("side", F.lit("left")))
    return both.select("doc_id", ints("input_ids").alias("ids"), ints("labels").alias("labels"), "side")


def _d_keep(arr: str, left: bool) -> str:
    budget = "greatest(128 - prompt_len, 0)"
    resp = f"{arr}[prompt_len + 1:]"
    if left:
        kept = f"CASE WHEN {budget} = 0 THEN {resp} ELSE {resp}[greatest(len({resp}) - {budget} + 1, 1):] END"
    else:
        kept = f"{resp}[1:{budget}]"
    return D.ints(f"list_concat({arr}[1:prompt_len], {kept})")


@query("clip_keep_prompt", D.ctes(**TOK) + f"SELECT doc_id, {_d_keep('input_ids', False)} AS ids, 'right' AS side FROM t UNION ALL SELECT doc_id, {_d_keep('input_ids', True)}, 'left' FROM t")
def clip_keep_prompt(spark, sf):
    rows = tokens(spark, sf)
    right = K.clip_keep_prompt(rows, 128).withColumn("side", F.lit("right"))
    left = K.clip_keep_prompt(rows, 128, "left").withColumn("side", F.lit("left"))
    return right.union(left).select("doc_id", ints("input_ids").alias("ids"), "side")


# ---- batches ------------------------------------------------------------------

BATCHED = {**TOK, "b": "SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch FROM t"}


def batched(spark, sf):
    return K.make_batches(tokens(spark, sf), "doc_id", 8)


@query("make_batches", D.ctes(**BATCHED) + "SELECT doc_id, batch FROM b")
def make_batches(spark, sf):
    return K.make_batches(I.table(spark, sf, "documents").select("doc_id"), "doc_id", 8)


_PADDED = "SELECT *, max(len(input_ids)) OVER (PARTITION BY batch) AS longest FROM b"


@query(
    "pad_batch",
    D.ctes(**BATCHED, p=_PADDED)
    + f"SELECT doc_id, md5({D.ints('list_concat(input_ids, list_transform(range(longest - len(input_ids)), lambda z: 0))')}) AS ids_md5, CAST(longest AS INT) AS n, CAST(len(input_ids) AS BIGINT) AS mask_sum FROM p",
)
def pad_batch(spark, sf):
    """Padded ids as md5, as the longest row of a batch sets the length of all."""
    out = K.pad_batch(batched(spark, sf))
    ones = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("doc_id", F.md5(ints("input_ids")).alias("ids_md5"), F.size("input_ids").alias("n"), ones.alias("mask_sum"))


@query(
    "prepend_bos",
    D.ctes(**BATCHED, s="SELECT *, bool_and(coalesce(labels[1] = -100, false)) OVER (PARTITION BY batch) AS skip FROM b")
    + f"SELECT doc_id, {D.ints('CASE WHEN skip THEN input_ids ELSE list_prepend(7, input_ids) END')} AS input_ids, {D.ints('CASE WHEN skip THEN labels ELSE list_prepend(-100, labels) END')} AS labels FROM s",
)
def prepend_bos(spark, sf):
    return K.prepend_bos(batched(spark, sf), 7, "batch").select("doc_id", ints("input_ids").alias("input_ids"), ints("labels").alias("labels"))


@query("drop_attention_mask", D.ctes(**TOK) + "SELECT doc_id, prompt_len FROM t")
def drop_attention_mask(spark, sf):
    rows = tokens(spark, sf).withColumn("attention_mask", A.fill(1, F.size("input_ids")))
    return K.drop_attention_mask(rows).drop("input_ids", "labels")


_CUT = f"""SELECT *, CASE WHEN {D.uniform('42', "'truncate'", 'batch')} < 0.5 THEN CAST(floor({D.uniform('42', "'length'", 'batch')} * longest) AS BIGINT) + 1 ELSE longest END AS cut FROM p"""


@query(
    "random_truncate",
    D.ctes(**BATCHED, p=_PADDED, c=_CUT)
    + f"""SELECT doc_id, {D.ints('list_transform(labels, lambda x, i: CASE WHEN i > cut THEN -100 ELSE x END)')} AS labels,
      {D.ints('list_transform(input_ids, lambda x, i: CASE WHEN i > cut THEN 0 ELSE 1 END)')} AS attention_mask FROM c""",
)
def random_truncate(spark, sf):
    out = K.random_truncate(batched(spark, sf), "batch", 0.5)
    return out.select("doc_id", ints("labels").alias("labels"), ints("attention_mask").alias("attention_mask"))


@query(
    "append_eos_block",
    D.ctes(**TOK, e="SELECT *, list_transform(range((32 - len(input_ids) % 32) % 32), lambda z: 1) AS fill FROM t")
    + f"SELECT doc_id, {D.ints('list_concat(input_ids, fill)')} AS input_ids, {D.ints('list_concat(labels, fill)')} AS labels FROM e",
)
def append_eos_block(spark, sf):
    return K.append_eos_block(tokens(spark, sf), 32).select("doc_id", ints("input_ids").alias("input_ids"), ints("labels").alias("labels"))


_KEPT = f"""SELECT *, first_value(len(input_ids) - prompt_len) OVER (PARTITION BY batch ORDER BY {D.uniform('42', "'keep'", 'batch', 'doc_id')}, doc_id) AS kept FROM b"""


@query(
    "perbatch_cutoff",
    D.ctes(**BATCHED, k=_KEPT) + f"SELECT doc_id, {D.ints('input_ids[1:len(input_ids) - greatest(len(input_ids) - prompt_len - kept, 0)]')} AS input_ids FROM k",
)
def perbatch_cutoff(spark, sf):
    return K.cut_batches(batched(spark, sf), "batch", "doc_id", perbatch=True, ratio=0.5).select("doc_id", ints("input_ids").alias("input_ids"))


_RESP = """SELECT *, min(len(input_ids) - prompt_len) OVER (PARTITION BY batch) AS lo, max(len(input_ids)) OVER (PARTITION BY batch) AS hi FROM b"""


@query(
    "resp_cutoff",
    D.ctes(**BATCHED, r=_RESP, n=f"""SELECT *, CASE WHEN {D.uniform('42', "'apply'", 'batch')} < 0.5 AND lo > 1 THEN hi - (CAST(floor({D.uniform('42', "'cut'", 'batch')} * (lo - 1)) AS BIGINT) + 1) ELSE hi END AS keep FROM r""")
    + f"SELECT doc_id, {D.ints('input_ids[1:keep]')} AS input_ids FROM n",
)
def resp_cutoff(spark, sf):
    return K.cut_batches(batched(spark, sf), "batch", "doc_id", ratio=0.5).select("doc_id", ints("input_ids").alias("input_ids"))


@query(
    "edit_source_pair",
    D.ctes(**TOK)
    + f"""SELECT doc_id, {D.ints('list_concat(input_ids[1:prompt_len], [2, 2, 2])')} AS x0, {D.ints('input_ids')} AS x1, 'prompt' AS start FROM t
      UNION ALL SELECT doc_id, '300', {D.ints('CASE WHEN input_ids[1] = 300 THEN input_ids ELSE list_prepend(300, input_ids) END')}, 'bos' FROM t""",
)
def edit_source_pair(spark, sf):
    rows = tokens(spark, sf)
    a = K.edit_source_pair(rows, 300, 3).withColumn("start", F.lit("prompt")).drop("prompt_len")
    b = K.edit_source_pair(rows.drop("prompt_len"), 300).withColumn("start", F.lit("bos"))
    return a.unionByName(b).select("doc_id", ints("x0_ids").alias("x0"), ints("x1_ids").alias("x1"), "start")


# ---- pairs --------------------------------------------------------------------

_HALVES = "SELECT doc_id, substr(text, 1, CAST(floor(length(text) / 2) AS INT)) AS context, substr(text, CAST(floor(length(text) / 2) AS INT) + 1) AS continuation FROM documents"


def _encode(c):
    return I.word_ids(T.words(c))


def _d_encode(x: str) -> str:
    return I.D_WORD_IDS.replace("(text,", f"({x},")


_PAIR = {
    "h": _HALVES,
    "e": f"SELECT doc_id, {_d_encode(D.rstrip('context'))} AS c, {_d_encode('concat(context, continuation)')} AS w FROM h",
}


@query(
    "encode_pair",
    D.ctes(**_PAIR) + f"SELECT doc_id, {D.ints('c')} AS context_ids, {D.ints('w[len(c) + 1:]')} AS continuation_ids FROM e WHERE len(c) + len(w[len(c) + 1:]) <= 512",
)
def encode_pair(spark, sf):
    out = K.encode_pair(I.run(spark, sf, _HALVES), "context", "continuation", _encode, 512)
    return out.select("doc_id", ints("context_ids").alias("context_ids"), ints("continuation_ids").alias("continuation_ids"))


@query(
    "encode_pair_cutoff",
    D.ctes(
        h=_HALVES,
        e=f"SELECT doc_id, {_d_encode(D.rstrip(chr(39) + '<s>' + chr(39) + ' || context'))} AS c, list_append({_d_encode(chr(39) + '<s>' + chr(39) + ' || concat(context, continuation)')}, 1) AS w FROM h",
        o="SELECT *, greatest(len(w) - 256, 0) AS over, len(c) - greatest(len(w) - 256, 0) AS remain FROM e",
    )
    + f"""SELECT doc_id, {D.ints('CASE WHEN over > 0 THEN (CASE WHEN remain > 0 THEN c[len(c) - remain + 1:] ELSE [] END) ELSE c END')} AS context_ids,
      {D.ints('CASE WHEN over > 0 AND remain <= 0 THEN w[len(w) - 255:] ELSE w[len(c) + 1:] END')} AS continuation_ids FROM o""",
)
def encode_pair_cutoff(spark, sf):
    out = K.encode_pair_cutoff(I.run(spark, sf, _HALVES), "context", "continuation", _encode, 256, "<s>")
    return out.select("doc_id", ints("context_ids").alias("context_ids"), ints("continuation_ids").alias("continuation_ids"))
