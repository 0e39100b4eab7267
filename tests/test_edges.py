"""Edge cases on literal rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evalweave.functions import ordering
from evalweave.functions import text as T
from evalweave.functions.ordering import head_rows, nth_keys, prefix_totals
from evalweave.operators import edits as E
from evalweave.operators import extract as X
from evalweave.operators import metrics as M
from evalweave.operators import noise as N
from evalweave.operators import project as P
from evalweave.operators import rewards as R
from evalweave.operators import scored as S
from evalweave.operators import select as L
from evalweave.operators import tasks as TK
from evalweave.operators import tokens as K
from evalweave.operators import verify as V
from evalweave.sources import mixture as MX
from evalweave.sources import readers as RD
from evalweave.sources import sinks as W

MARK = X.PROOF_MARKER


def one(spark, value, fn, type_="string"):
    return spark.createDataFrame([(value,)], f"x {type_}").select(fn(F.col("x")).alias("y")).first()["y"]


# ---- text -----------------------------------------------------------------------


def test_strip_like_python(spark):
    s = "　\x1c\t a b \x85\n"
    assert one(spark, s, T.strip) == s.strip()


# ---- extraction -------------------------------------------------------------------


def source(spark, text, variant=X.AUTOREGRESSIVE):
    df = spark.createDataFrame([(text,)], "completion string")
    return X.with_source(df, "completion", "s", variant).first()["s"]


def test_blank_closed_block_hides_an_open_fence(spark):
    text = f"p\n{MARK}\n```lean4\n \n```\n```lean4\ntheorem t : 1 = 1 := by rfl"
    assert source(spark, text) is None
    assert source(spark, text, X.DIFFUSION) is None


def test_blank_block_after_a_bare_theorem_differs_by_variant(spark):
    text = f"theorem t : 1 = 1 := by rfl\n{MARK}\n```lean4\n\n```"
    assert source(spark, text) is None
    assert source(spark, text, X.DIFFUSION) == text.strip()


def test_last_of_two_markers_counts(spark):
    text = f"a{MARK}b{MARK}\n```lean\nx\n```"
    df = X.add_sample_fields(spark.createDataFrame([(text, "theorem t")], "completion string, formal_statement string")).first()
    assert df["reasoning"] == f"a{MARK}b"
    assert df["lean_code_block"] == "x"
    assert df["complete_lean_proof_section"].startswith(MARK)


def test_header_with_crlf_and_variants(spark):
    s = "import Mathlib\r\nopen Real\r\n-- note\r\n/-- open Nat -/\r\nimport Late\r\ntheorem t"
    assert one(spark, s, X.header) == "import Mathlib\nopen Real"
    assert one(spark, "theoremx\nopen Real", X.header) == "open Real"
    # a declaration that ends its line stops only the variant that matches words
    s = "theorem\nopen Real"
    assert one(spark, s, X.header) == "open Real"
    assert one(spark, s, lambda c: X.header(c, X.DIFFUSION)) == X.DEFAULT_HEADER
    assert one(spark, None, X.header) == X.DEFAULT_HEADER


def test_end_of_turn_needs_end_of_sequence(spark):
    df = spark.createDataFrame([([0, 5, 9, 9, 8],)], "s array<int>")
    _, both = X.generated_part(F.col("s"), F.lit(1), 0, None, 8)
    _, needs = X.generated_part(F.col("s"), F.lit(1), 0, None, 8, needs_eos=True)
    row = df.select(both.alias("a"), needs.alias("b")).first()
    assert row["a"] == [9, 9] and row["b"] == [9, 9, 8]


# ---- statements -------------------------------------------------------------------


def canonical(spark, text, only):
    return V.with_canonical(spark.createDataFrame([(text,)], "t string"), "t", "c", only).first()["c"]


def test_canonical_forms(spark):
    assert canonical(spark, "/- theorem a : b -/ lemma foo (h₁ : ℝ) :=  by\n sorry", True) == "lemma __THEOREM_NAME__ (h₁ : ℝ) := by"
    assert canonical(spark, "", True) is None
    assert canonical(spark, "sorry", False) == ""
    # a name longer than its stand-in hides a proof start that follows at once
    long = "theorem " + "n" * 22 + " := by simp := by done"
    assert canonical(spark, long, True) == "theorem __THEOREM_NAME__ := by simp := by"
    assert canonical(spark, "theorem short := by simp", True) == "theorem __THEOREM_NAME__ := by"


def slots(spark, rows):
    return spark.createDataFrame(rows, "dataset_index long, slot int, formal_statement string, proof string")


def test_routes(spark):
    st = "theorem a : 1 = 1 := by"
    rows = [
        (0, 1, st, None),
        (0, 2, st, "lemma b : 2 = 2 := by rfl"),
        (0, 3, "  ", "lemma b : 2 = 2 := by rfl"),
        (0, 4, st, "theorem zz : 1  =  1 := by rfl"),
    ]
    got = {r["slot"]: r for r in V.route(slots(spark, rows)).collect()}
    assert [got[i]["route"] for i in range(1, 5)] == ["empty", "mismatch", "verify", "verify"]
    swapped = {r["slot"]: r for r in V.route(slots(spark, rows), V.SUBSTITUTE).collect()}
    assert swapped[2]["substituted"] and swapped[2]["route"] == "verify"
    assert swapped[2]["proof"] == "theorem a : 1 = 1 := by rfl"
    with pytest.raises(ValueError):
        V.prepare_match(slots(spark, rows), "fuzzy")


def test_substitution_keeps_the_prefix(spark):
    rows = [(0, 1, "theorem a : 1 = 1 := by sorry", "import M\n\nlemma b : 2 = 2 :=\n by\n rfl")]
    row = V.prepare_match(slots(spark, rows), V.SUBSTITUTE).first()
    assert row["proof"] == "import M\ntheorem a : 1 = 1 := by\n rfl"


def test_slot_stats_and_pass(spark):
    rows = [(0, 1, "verify", True, True), (0, 2, "empty", False, False), (1, 1, "mismatch", False, False), (1, 2, "verify", None, None)]
    df = spark.createDataFrame(rows, "dataset_index long, slot int, route string, pass boolean, complete boolean")
    total = V.slot_stats(df).filter("slot IS NULL").first()
    assert (total["total"], total["valid"], total["verified"], total["error"], total["null_count"]) == (4, 3, 2, 1, 1)
    problems = spark.createDataFrame([(0,), (1,), (2,)], "dataset_index long")
    p = V.pass_at_n(df, problems=problems).first()
    assert p["total_problems"] == 3 and p["problems_with_complete"] == 1 and p["n"] == 2


def test_bad_verdicts(spark):
    rows = [('{"messages":[{"severity":"err',), (None,), ('{"messages":[{"severity":"warning","data":"declaration uses \'sorry\'"}]}',)]
    got = V.parse_verdict(spark.createDataFrame(rows, "j string"), "j").collect()
    assert [r["pass"] for r in got] == [False, False, True]
    assert [r["complete"] for r in got] == [False, False, False]
    assert got[0]["system_errors"] and got[2]["system_errors"] is None


def test_records_with_and_without_samples(spark):
    schema = "dataset_index long, formal_statement string, merged_proof string, samples array<struct<completion: string, verification_source: string>>"
    rows = [(0, "s", None, [("```lean\ntheorem x\n```", None), ("no", "import A")]), (1, "s", "proof", None), (2, "s", None, [])]
    got = V.normalize_slots(spark.createDataFrame(rows, schema)).orderBy("dataset_index", "slot").collect()
    assert [(r["dataset_index"], r["slot"], r["n"]) for r in got] == [(0, 1, 2), (0, 2, 2), (1, 1, 1)]
    assert got[0]["proof"] == X.DEFAULT_HEADER + "\n\ntheorem x" and got[1]["proof"] == "import A" and got[2]["proof"] == "proof"


def test_slots_of_wide_records(spark):
    """Three forms of records in one table, told apart row by row, with what each slot carries."""
    schema = """dataset_index long, formal_statement string, n int, merged_proof string, merged_proof_1 string, merged_proof_3 string, reasoning string, reasoning_1 string,
        completion_10 string, samples array<struct<sample_id: int, completion: string, reasoning: string, raw_completion: string>>"""
    section = "plan\n### Complete Lean 4 Proof\n```lean4\ntheorem x := by simp\n```"
    rows = [
        (0, "s", 9, None, None, None, "record", None, None, [(0, section, "why", None), (1, "no", None, "```lean4\nimport Z\n```")]),
        (1, "s", None, "p", "q", None, "record", None, None, None),
        (2, "s", 4, None, "a", "c", None, "r1", "x", None),
        (3, "s", None, None, "only", None, None, None, None, None),
        (4, "s", 2, None, None, None, None, None, None, None),
        (5, "s", 2, None, None, None, None, None, None, []),
        (6, "s", 0, None, "none asked for", None, None, None, None, None),
    ]
    out = V.normalize_slots(spark.createDataFrame(rows, schema))
    assert out.columns == ["dataset_index", "formal_statement", "n", "slot", "field", "proof", *V.CARRIED]
    got = {(r["dataset_index"], r["slot"]): r for r in out.collect()}
    assert sorted(got) == [(0, 1), (0, 2), (1, 1), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (4, 1)]
    assert [got[k]["n"] for k in sorted(got)] == [2, 2, 1, 4, 4, 4, 4, 1, 1]
    assert got[0, 1]["proof"].endswith("theorem x := by simp") and got[0, 1]["reasoning"] == "why" and "theorem x" in got[0, 1]["complete_lean_proof_section"]
    assert got[0, 2]["proof"] == "import Z" and got[0, 2]["raw_completion"].startswith("```") and got[0, 2]["field"] == "merged_proof_2"
    assert got[1, 1]["proof"] == "p" and got[1, 1]["field"] == "merged_proof" and got[1, 1]["reasoning"] == "record"
    assert [got[2, i]["proof"] for i in range(1, 5)] == ["a", None, "c", None] and got[2, 1]["reasoning"] == "r1"
    assert got[4, 1]["proof"] is None


def test_verdicts_without_the_checker(spark):
    rows = [(1, "theorem a : x := by\n  sorry", None), (2, "theorem a : x := by\n  sorry", "theorem b : y := by\n  simp"), (3, None, "anything"), (4, "theorem a : x := by\n  sorry", "theorem a : x := by\n  simp")]
    df = spark.createDataFrame(rows, "slot int, formal_statement string, proof string").withColumn("field", F.concat(F.lit("merged_proof_"), F.col("slot").cast("string")))
    got = {r["slot"]: r["route_verdict"] for r in V.route(df).collect()}
    assert got[3] is None and got[4] is None
    assert got[1]["errors"][0]["data"] == "merged_proof_1 is null or empty" and got[1]["statement_match_failed"] is None and got[1]["verify_time"] == 0
    assert got[2]["errors"][0]["data"].endswith("(statement_match=exact)") and got[2]["statement_match_failed"] and not got[2]["pass"]
    assert (got[2]["formal_statement_match"], got[2]["formal_statement_match_original"], got[2]["formal_statement_substituted"]) == (False, False, False)


# ---- order, limits, splits ---------------------------------------------------------


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_positions_are_dense_with_sparse_and_skewed_keys(spark, monkeypatch, few):
    """Ranges of few rows, blocks of few ranges, offsets broadcast or joined."""
    monkeypatch.setattr(ordering, "FEW", few)
    monkeypatch.setattr(ordering, "BLOCK", 3)
    keys = [i * i * i for i in range(500)] + [10**12 + i for i in range(500)]
    df = spark.createDataFrame([(k, "a" if k < 10**12 else "b", k % 7) for k in keys], "k long, g string, v int").repartition(7)
    got = prefix_totals(df, "k", "i", range_rows=60).orderBy("k").collect()
    assert [r["i"] for r in got] == list(range(1000)) and got[3].asDict() == {"k": 27, "g": "a", "v": 27 % 7, "i": 3}
    per = prefix_totals(df, "k", "i", by=["g"], range_rows=60).orderBy("k").collect()
    assert [r["i"] for r in per] == list(range(500)) * 2
    sums = prefix_totals(df, "k", "s", F.col("v"), by=["g"], range_rows=60).orderBy("k").collect()
    for half in (sums[:500], sums[500:]):
        assert [r["s"] for r in half] == [sum(x["v"] for x in half[:i]) for i in range(500)]


def test_ranges_follow_the_rows(spark):
    """Ten times the rows give ten times the ranges, and none holds much more than the set rows."""
    for n in (3_000, 30_000):
        rows, ranges = ordering.sorted_ranges(spark.range(n).withColumnRenamed("id", "k"), ["k"], 1_000)
        sizes = [r["count"] for r in rows.groupBy("_range").count().collect()]
        assert len(sizes) == ranges == n // 1_000 and max(sizes) < 2_500
    assert ordering.ranked(spark.range(0).withColumnRenamed("id", "k"), ["k"], "p").count() == 0


def test_positions_of_null_keys_groups_and_repeated_queries(spark):
    df = spark.createDataFrame([(None, None), (1, None), (2, "g"), (None, "g")], "k long, g string")
    out = prefix_totals(df.withColumn("x", F.lit(1)), "k", "i", by=["g"])
    want = {(None, None, 0), (1, None, 1), (None, "g", 0), (2, "g", 1)}
    assert {(r["k"], r["g"], r["i"]) for r in out.collect()} == want == {(r["k"], r["g"], r["i"]) for r in out.collect()}


def test_heads(spark):
    df = spark.range(100).withColumnRenamed("id", "k").repartition(5)
    for n in (0, 1, 37, 100, 500):
        assert head_rows(df, "k", lambda t, n=n: n).count() == min(n, 100)
    assert nth_keys(df, "k", {"c": (None, lambda t: 10)}) == {"c": 9}


@pytest.mark.parametrize("held, longest", [(1 << 17, 64), (3, 64), (0, 64), (1 << 17, 2)])
def test_words_looked_up_or_joined(spark, monkeypatch, held, longest):
    """Whether a task holds all words, the first few or none: the ids are the same."""
    monkeypatch.setattr(K, "HELD", held)
    monkeypatch.setattr(K, "LONGEST", longest)
    vocab = K.build_vocab(spark.createDataFrame([(["aaa"] * 5 + ["bbb"] * 4 + ["c"] * 3 + ["dd", "eee"],)], "w array<string>"), "w")
    ids = {r["word"]: r["id"] for r in vocab.collect()}
    assert ids == {"aaa": 4, "bbb": 5, "c": 6, "dd": 7, "eee": 8}
    rows = {1: ["eee", "aaa", "nope", "eee", None, "dd", "c"], 2: [], 3: None, 4: ["nope"] * 3, 5: ["aaa"] * 50, 6: ["dd"]}
    df = spark.createDataFrame(list(rows.items()), "word long, words array<string>").withColumn("id", F.lit(1))
    got = {r["word"]: list(r["input_ids"]) for r in K.encode_words(df, "word", "words", vocab).collect()}
    assert got == {k: [ids.get(w, 3) for w in ws or []] for k, ws in rows.items()}


def test_cuts_by_rounds(spark, monkeypatch):
    """Wide, dense and clustered keys, several cuts in one go, narrowed to a few rows by few steps."""
    monkeypatch.setattr(ordering, "STEPS", 3)
    rng = random.Random(8)
    big = 2**63 - 1
    cases = [
        [-big, big, 0, 1, 2, 3, 4, 5], sorted(rng.sample(range(-10**15, 10**15), 400)), list(range(300)),
        [5] * 1, [10**18 + i for i in range(150)] + [-(10**18) - i for i in range(150)],
    ]
    for keys in cases:
        df = spark.createDataFrame([(k, k % 2 == 0) for k in keys] + [(None, True)], "k long, even boolean").repartition(3)
        even = sorted(k for k in keys if k % 2 == 0)
        ranks = {"first": 1, "third": len(keys) // 3, "last": len(keys), "over": 10**9}
        cuts = {n: (None, lambda t, r=r: r) for n, r in ranks.items()} | {"even": (F.col("even"), lambda t: (t + 1) // 2), "none": (F.lit(False), lambda t: 5)}
        want = {n: sorted(keys)[min(r, len(keys)) - 1] if r else None for n, r in ranks.items()}
        want |= {"even": even[(len(even) + 1) // 2 - 1] if even else None, "none": None}
        for rows in (1, 7):
            assert nth_keys(df, "k", cuts, cut_rows=rows) == want


def test_cuts_of_equal_leads(spark):
    df = spark.createDataFrame([(i // 50, f"w{i:04d}") for i in range(200)], "lead long, word string")
    for rank in (1, 50, 51, 199, 200):
        assert nth_keys(df, "lead", {"c": (None, lambda t: rank)}, F.col("word"), cut_rows=5) == {"c": f"w{rank - 1:04d}"}


def test_limits_of_several_splits(spark):
    rows = [(i, s) for i, s in enumerate(["a", "b", "c", None] * 25)]
    df = spark.createDataFrame(rows, "k long, split string")
    got = {(r["k"], r["split"]) for r in L.limit_split(df, {"a": 3, "b": 0, "zz": 4}, "k", ["a", "b", "c"]).collect()}
    assert got == {(0, "a"), (4, "a"), (8, "a")} | {(k, s) for k, s in rows if s in ("c", None)}


def test_single_split_limits_overlap_or_not(spark):
    df = spark.range(10).select(F.col("id").alias("k"), F.lit("train").alias("split"))
    both = L.limit_split(df, {"train": 6, "test": 3}, "k", ["train"])
    assert both.filter("split = 'test'").count() == 3 and both.filter("split = 'train' AND k < 3").count() == 3
    apart = L.limit_split_stream(df, {"train": 6, "test": 3}, "k", ["train"])
    assert sorted(r["k"] for r in apart.filter("split = 'train'").collect()) == list(range(3, 9))
    with pytest.raises(ValueError):
        L.limit_split_stream(df, {"test": 3}, "k", ["train", "valid"])


def test_split_fraction_is_exact_and_repeats(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = L.split_fraction(df, "k", 0.05).filter("split = 'test'").select("k")
    b = L.split_fraction(df.repartition(9), "k", 0.05).filter("split = 'test'").select("k")
    assert a.count() == 50 and a.exceptAll(b).count() == 0


def test_shards_cover_all_rows(spark):
    df = spark.range(11).withColumnRenamed("id", "k")
    got = [sorted(r["k"] for r in L.shard(df, "k", 4, i).collect()) for i in range(1, 5)]
    assert got == [[0, 1], [2, 3, 4], [5, 6, 7], [8, 9, 10]]
    with pytest.raises(ValueError):
        L.shard(df, "k", 4, 5)


def test_language_needs_a_known_configuration(spark):
    with pytest.raises(NotImplementedError):
        L.in_language(spark.range(1), "other", "en")


def test_mixture_specs():
    assert MX.specs_of("a/b[train:5_000,name:x] + c|d[]") == [
        MX.SourceSpec("a/b", {"name": "x"}, {"train": 5000}), MX.SourceSpec("c"), MX.SourceSpec("d"),
    ]
    with pytest.raises(ValueError):
        MX.specs_of("a[oops]")
    with pytest.raises(ValueError):
        MX.specs_of(" + ")


def test_file_rules():
    assert W.verified_path("a/x.jsonl") == "a/x_verified.json"
    assert W.verified_path("x.json") == "x_verified.json"
    assert W.verified_path("x") == "x_verified.json"
    assert RD.file_jobs(["a", "b"], None) == [("a", None), ("b", None)]
    for bad in ((None, None), (["a", "b"], "o"), (["a"], ["o", "p"])):
        with pytest.raises(ValueError):
            RD.file_jobs(*bad)


def test_newest_file(spark, tmp_path):
    import os

    for i, name in enumerate(("run_1.jsonl", "run_2.jsonl", "run_3.part.jsonl")):
        (tmp_path / name).write_text("{}\n")
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    assert RD.latest_file(spark, str(tmp_path), "run_*.jsonl").endswith("run_2.jsonl")
    with pytest.raises(FileNotFoundError):
        RD.latest_file(spark, str(tmp_path), "other_*")


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"dataset_index": 1},\n {"dataset_index": 2}]')
    (tmp_path / "b.jsonl").write_text('{"dataset_index": 1}\n\n{"dataset_index": 2}\n')
    for f in ("a.json", "b.jsonl"):
        assert sorted(r["dataset_index"] for r in RD.json_records(spark, str(tmp_path / f)).collect()) == [1, 2]


# ---- chat --------------------------------------------------------------------------


def chat(spark, *turns):
    return spark.createDataFrame([([(r, c) for r, c in turns],)], "m array<struct<role: string, content: string>>")


def test_chat_texts(spark):
    df = chat(spark, ("system", " s "), ("tool", "x"), ("user", "q\n"))
    row = df.select(P.render_header(F.col("m"), True, "<s>").alias("h"), P.render_sections(F.col("m"), True).alias("s")).first()
    assert row["s"] == "[SYS]\ns\n[/SYS]\n\n[Question]\nq\n[/Question]\n\n[Answer]\n"
    assert row["h"].startswith("<s><|start_header_id|>system<|end_header_id|>\n\ns<|eot_id|>")
    assert row["h"].endswith("<|start_header_id|>assistant<|end_header_id|>\n\n")


def test_first_turn_does_not_look_further(spark):
    df = chat(spark, ("assistant", "early"), ("user", "q"), ("assistant", "  "), ("user", "r"), ("assistant", "a"))
    assert df.select(P.first_turn_nested(F.col("m")).alias("f")).first()["f"] is None
    df = chat(spark, ("assistant", "early"), ("user", " q "), ("assistant", "a"))
    f = df.select(P.first_turn_nested(F.col("m")).alias("f")).first()["f"]
    assert (f["prompt"], f["response"]) == ("q", "a")


# ---- tokens -------------------------------------------------------------------------


def test_empty_and_ended_rows_get_one_eos(spark):
    df = spark.createDataFrame([([],), ([5],), ([5, 1],)], "i array<int>")
    assert [r[0] for r in df.select(K.append_eos(F.col("i"))).collect()] == [[1], [5, 1], [5, 1]]


def test_left_clip_with_nothing_left(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], 2)], "input_ids array<int>, prompt_len int")
    assert K.clip_keep_prompt(df, 2, "left").first()["input_ids"] == [1, 2, 3, 4]
    assert K.clip_keep_prompt(df, 2, "left", whole_at_zero=False).first()["input_ids"] == [1, 2]
    assert K.clip_keep_prompt(df, 3, "left").first()["input_ids"] == [1, 2, 4]
    assert K.clip_keep_prompt(df, 3).first()["input_ids"] == [1, 2, 3]


def brute_pack(rows, length, batch, drop):
    out = []
    for i in range(0, len(rows), batch):
        flat = [t for r in rows[i : i + batch] for t in r]
        out += [flat[j : j + length] for j in range(0, len(flat), length)]
    return [c for c in out if len(c) == length or not drop]


@pytest.mark.parametrize("drop", [True, False])
def test_packing_against_brute_force(spark, drop):
    rows = [list(range(i, i + (i * 7) % 11)) for i in range(53)]
    df = spark.createDataFrame(list(enumerate(rows)), "k long, input_ids array<int>").repartition(6)
    got = K.pack_sequences(df, "k", 8, batch_rows=10, drop_tail=drop).orderBy("pack_group", "chunk").collect()
    assert [r["input_ids"] for r in got] == brute_pack(rows, 8, 10, drop)
    whole = K.pack_sequences(df, "k", 8, batch_rows=None, drop_tail=drop).orderBy("chunk").collect()
    assert [r["input_ids"] for r in whole] == brute_pack(rows, 8, 1000, drop)


def test_vocabulary_order_and_unknown_words(spark):
    df = spark.createDataFrame([(0, ["b", "a", "b", "é"]), (1, [])], "k long, w array<string>")
    vocab = K.build_vocab(df, "w")
    assert {r["word"]: r["id"] for r in vocab.collect()} == {"b": 4, "a": 5, "é": 6}
    other = spark.createDataFrame([(7, ["é", "zz", "b"]), (8, [])], "k long, w array<string>")
    assert {r["k"]: r["input_ids"] for r in K.encode_words(other, "k", "w", vocab).collect()} == {7: [6, 3, 4], 8: []}


def test_stream_and_batch_post_process_agree(spark, tmp_path):
    df = spark.createDataFrame([([1] * n, n // 2) for n in range(1, 20)], "input_ids array<int>, prompt_len int")
    df.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    for mode in ("filter", "right"):
        K.post_process(stream, 6, mode).writeStream.format("memory").queryName(f"pp_{mode}").trigger(availableNow=True).start().awaitTermination()
        got = sorted(tuple(r) for r in spark.table(f"pp_{mode}").collect())
        assert got == sorted(tuple(r) for r in K.post_process(df, 6, mode).collect())


# ---- noise ---------------------------------------------------------------------------


def brute_cart(masked, p):
    out = []
    for i, m in enumerate(masked):
        if m:
            out.append(sum(0.5 * p * (1 - p) ** (abs(i - j) - 1) for j, n in enumerate(masked) if not n))
        else:
            out.append(0.0)
    return out


@pytest.mark.parametrize("p", [0.3, 0.9, 0.999])
def test_cart_weights_against_brute_force(spark, p):
    """Rows of all lengths in one batch: what one row hands on never reaches the next."""
    rows = [[(i * i) % 7 < 3 or 200 < i < 420 for i in range(1200)], [], None, [True], [False], [True, False], [False] * 700, [True] * 300 + [False], [None, True, False], [False] * 9, [True] * 50, [True] * 7]
    df = spark.createDataFrame(list(enumerate(rows)), "k long, masked array<boolean>").coalesce(1)
    got = {r["k"]: r["cart_weight"] for r in N.with_cart_weights(df, p=p).collect()}
    for k, masked in enumerate(rows):
        assert got[k] is None if masked is None else got[k] == pytest.approx(brute_cart([bool(m) for m in masked], p), rel=1e-9, abs=1e-12)
        assert masked is None or not all(masked) or not any(got[k])  # exactly 0 after a row that hands much on


def test_weights_of_all_kinds(spark):
    df = spark.createDataFrame([([True, False, True], 0.5)], "masked array<boolean>, t double")
    assert N.with_loss_weights(df, "uniform").first()["loss_weight"] == [1.0] * 3
    assert N.with_loss_weights(df, "scheduler").first()["loss_weight"] == pytest.approx([2.0] * 3, rel=1e-5)
    for kind, p in (("cart", 0.3), ("cart[geo_p:0.5]", 0.5)):
        assert N.with_loss_weights(df, kind).first()["loss_weight"] == pytest.approx([0.5 * p, 0, 0.5 * p])
    for kind in ("cart[geo_p:2]", "cartwheel", "other"):
        with pytest.raises(NotImplementedError):
            N.with_loss_weights(df, kind)


def test_schedules_check_their_range(spark):
    df = spark.createDataFrame([(1.5,)], "t double")
    with pytest.raises(Exception, match="not in"):
        df.select(N.alpha(F.col("t"))).collect()
    with pytest.raises(ValueError):
        N.kappa(F.col("t"), "steps")


def test_exact_masking_counts(spark):
    df = spark.createDataFrame([(0, list(range(30)), 10)], "k long, input_ids array<int>, prompt_len int")
    for r in N.mask_noise_exact_k(df, "k", 4).collect():
        assert sum(r["masked"]) == r["n_masked"] and not any(r["masked"][:10])
        assert r["p_mask"] == r["n_masked"] / 20


def test_masked_tokens_are_trainable(spark):
    df = spark.createDataFrame([(i, list(range(40)), [-100] * 10 + list(range(10, 40))) for i in range(20)], "k long, input_ids array<int>, labels array<int>")
    for r in N.mask_noise(df, "k").collect():
        assert not any(r["masked"][:10])


def test_completion_masks(spark):
    df = spark.createDataFrame([([5, 1, 5],), ([5, 5],), ([],)], "i array<int>")
    assert [r[0] for r in df.select(N.completion_mask(F.col("i"), 1)).collect()] == [[1, 1, 0], [1, 1], []]
    assert [r[0] for r in df.select(N.completion_mask(F.col("i"), 1, True)).collect()] == [[1, 1, 0], [0, 0], []]


def test_remaining_edits(spark):
    df = spark.createDataFrame([(0, [7, -1, 3, 4, 5], [7, 2, -1, 4, 6])], "k long, zt array<int>, z1 array<int>")
    got = [(r["kind"], r["pos"], r["token"]) for r in E.remaining_edits(df, "k", "zt", "z1").orderBy("j").collect()]
    assert got == [("INS", 0, 2), ("DEL", 1, None), ("SUB", 3, 6)]


def test_edit_out_of_range_fails(spark):
    pairs = spark.createDataFrame([(0, 1.0, 2, 1)], "k long, w double, x1_len int, cur_len int")
    rates = spark.createDataFrame([(0, 0, 0.1, 0.1, 0.1, -1.0, -1.0)], "k long, pos long, sub double, del double, ins double, log_sub double, log_ins double")
    edits = spark.createDataFrame([(0, 5, "DEL")], "k long, pos long, kind string")
    with pytest.raises(Exception, match="out of range"):
        E.edit_rate_loss(pairs, rates, edits, "k").collect()


def test_schedules_of_steps(spark):
    df = spark.createDataFrame([(32, 5), (3, 5)], "n int, s int")
    assert [r[0] for r in df.select(S.even_schedule(F.col("n"), F.col("s"))).collect()] == [[7, 7, 6, 6, 6], [1, 1, 1, 0, 0]]
    got = [r[0] for r in df.select(S.transfer_schedule(F.col("n"), 4)).collect()]
    assert sum(got[0]) == 32 and all(x > 0 for x in got[0])


# ---- rewards ---------------------------------------------------------------------------


def test_strict_layout_allows_one_more_newline(spark):
    ok = "<reasoning>\na\n</reasoning>\n<answer>\n1\n</answer>\n"
    for text, want in ((ok, 0.5), (ok + "\n", 0.5), (ok + "\n\n", 0.0), (ok[:-1], 0.0)):
        assert one(spark, text, R.strict_format) == want


def test_boxes(spark):
    cases = {
        "a \\boxed{1} \\boxed{\\frac{1}{2}} z": "\\frac{1}{2}",
        "\\boxed{1": None,
        "\\fbox{3}": "\\fbox{3}",
        "\\boxed 7$ rest": "7",
        "none": "none",
    }
    for text, want in cases.items():
        assert one(spark, text, lambda c: R.unboxed(R.boxed_last(c))) == want


def test_equivalence(spark):
    rows = [
        ("\\frac12", "\\frac{1}{2}", True), ("0.5", "1/2", True), ("x=3", "3", True), ("5\\text{ cm}", "5", True),
        ("\\sqrt3", "\\sqrt{3}", True), ("\\frac", "\\frac", True), ("\\frac", "\\frac ", False), ("a/b", "a/b", True),
        ("a/b", "a /b", False), ("a\\text{ x}\\text{ y}", "a", False), (None, None, True), (None, "1", False),
        ("03/4", "\\frac{3}{4}", False), ("50\\%", "50", True), (".5", "1/2", True), ("\\sqrt", "\\sqrt", True),
    ]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    for r in R.with_equiv(df, "a", "b", "got").collect():
        assert r["got"] == r["want"], (r["a"], r["b"])


def test_unclosed_truth_has_no_score(spark):
    df = spark.createDataFrame([("\\boxed{1", "\\boxed{1}"), ("\\boxed{1}", "\\boxed{1")], "c string, t string")
    assert [r["reward"] for r in R.with_math_reward(df, "c", "t").collect()] == [0.0, None]


@pytest.mark.parametrize(
    "text, want",
    [
        ("1+2*3", 7), ("(1+2)*3", 9), ("2*-3", -6), ("--4", 4), ("8/4/2", 1), ("1-2-3", -4), ("1-(2-(3-4))*2", -5), ("1/0", None), ("1/(2-2)", None),
        ("(1", None), ("1)", None), ("()", None), ("1 2", None), ("1+", None), ("*2", None), ("007+1", None), ("0+1", 1), ("1.5*2", 3), (".5+1", 1.5),
        ("(1)(2)", None), ("3(2)", None), ("2 * ( 3 + 4 ) - 5 / 2", 11.5), ("(1\n+2)", 3), ("1\n+2", None), ("", None), ("-(3)", -3), ("(-3)*(+2)", -6), ("2+-(1+1)", 0),
        ("2**3", 8), ("2**3**2", 512), ("(2**3)**2", 64), ("-2**2", -4), ("(-2)**2", 4), ("2**-1", 0.5), ("2**-2**2", 0.0625), ("3*2**2", 12), ("2**2*3", 12),
        ("1-2**2", -3), ("1--2**2", 5), ("0**-1", None), ("0**0", 1), ("(0-8)**0.5", None), ("2* *3", None), ("2**", None), ("**2", None), ("2***3", None),
        ("7//2", 3), ("-7//2", -4), ("5-2//3", 5), ("7//2*2", 6), ("7/2//1", 3), ("7//0", None), ("7//(1/2)", 14), ("2//3/4", 0), ("9//2**2", 2), ("1///2", None),
        ("10-2**2**0//1", 8), ("(1+2)**(1+1)//2-1", 3), ("9**9**9", None),
    ],
)
def test_arithmetic(spark, text, want):
    got = one(spark, text, R.arithmetic)
    assert got is None if want is None else got == pytest.approx(want)


def test_countdown_scores(spark):
    rows = [("none", 0.0), ("<answer>1+2+4</answer>", 0.1), ("<answer>1+2+3</answer>", 1.0), ("<answer>1*2*3</answer>", 1.0), ("<answer>3-2-1</answer>", 0.1), ("<answer>3*2**1</answer>", 1.0), ("<answer>1*2*3//1</answer>", 0.1)]
    df = spark.createDataFrame(rows, "c string, want double").withColumn("n", F.array(F.lit(3), F.lit(1), F.lit(2))).withColumn("t", F.lit(6))
    for r in R.with_countdown_reward(df, "c", "n", "t").collect():
        assert r["reward"] == r["want"], r["c"]


def test_sudoku_pads_and_cuts(spark):
    full, puzzle = "1234341221434321", "0234341221434320"
    rows = [(f"<answer>{full}</answer>", 1.0), ("<answer>1</answer>", 0.5), (f"<answer>{full}99</answer>", 1.0), ("<answer></answer>", 0.0), ("x", 0.0)]
    df = spark.createDataFrame(rows, "c string, want double").withColumn("p", F.lit(puzzle)).withColumn("s", F.lit(full))
    for r in R.with_sudoku_reward(df, "c", "p", "s").collect():
        assert r["reward"] == r["want"], r["c"]
    none_empty = df.withColumn("p", F.lit(full))
    assert {r["reward"] for r in R.with_sudoku_reward(none_empty, "c", "p", "s").collect()} == {0.0}


def test_unknown_task():
    with pytest.raises(ValueError):
        TK.task("chess")


def test_code_task_without_results(spark):
    df = spark.createDataFrame([("x", "assert f(1)")], "completion string, tests string")
    with pytest.raises(ValueError, match="unit-test"):
        TK.score(df, TK.task("code").rewards)


def test_single_member_group(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, 4.0)], "g long, reward double")
    got = {(r["g"], r["reward"]): r for r in M.group_advantage(df, "g", scale=True).collect()}
    assert got[(0, 1.0)]["advantage"] is None
    assert got[(1, 4.0)]["advantage"] == pytest.approx(1.0 / (math.sqrt(2) + 1e-4))


def test_no_completion_ended(spark):
    df = spark.createDataFrame([(3, False), (5, False)], "n int, e boolean")
    r = M.length_stats(df, "n", "e").first()
    assert r["max_terminated"] == 0.0 and r["clipped_ratio"] == 1.0 and r["mean_length"] == 4.0


def test_flops_without_sizes(spark):
    df = spark.createDataFrame([(1, 2, 3)], "batch_size int, query_len int, kv_len int")
    assert M.forward_flops(df, M.ModelDims()).first()["total_flops"] == 0.0


# ---- answers, NULLs and files that must not be taken for good ones --------------------


@pytest.mark.parametrize(
    "raw",
    [
        '{"messages": null}', '{"messages": 3}', '{"messages": [null]}', '{"messages": [{"data": "x"}]}', "[]", '[{"env": 0}]', "null", "5", "",
        '{"messages": [{"severity": "warning"}]}', '{"messages": [{"severity": "warning", "data": null}]}', '{"messages": [{"severity": "warning", "data": 5}]}',
    ],
)
def test_malformed_answers_never_pass(spark, raw):
    got = V.parse_verdict(spark.createDataFrame([(raw,)], "r string"), "r").first()
    assert (got["pass"], got["complete"]) == (False, False) and got["system_errors"] is not None


def test_first_telling_warning_decides(spark):
    spoiled = '{"messages": [{"severity": "warning", "data": "failed"}, {"severity": "warning", "data": 7}]}'
    failed = '{"sorries": null, "messages": [{"severity": "error", "data": "e"}, {"severity": "warning"}]}'
    got = V.parse_verdict(spark.createDataFrame([(0, spoiled), (1, failed)], "i int, r string"), "r").orderBy("i").collect()
    assert [(r["pass"], r["complete"], r["system_errors"]) for r in got] == [(True, False, None), (False, False, None)]


def test_rows_without_words_or_split_stay(spark):
    words = spark.createDataFrame([(1, ["a"]), (2, None), (3, [])], "k long, w array<string>")
    vocab = spark.createDataFrame([("a", 9)], "word string, id int")
    assert sorted((r["k"], r["input_ids"]) for r in K.encode_words(words, "k", "w", vocab).collect()) == [(1, [9]), (2, []), (3, [])]
    rows = spark.createDataFrame([(1, "train"), (2, None), (3, "train"), (4, "test")], "k long, split string")
    got = L.limit_split(rows, {"train": 1}, "k", ["train", "test"])
    assert sorted(r["k"] for r in got.collect()) == [1, 2, 4]


def test_verified_records_read_back_whole(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2 == 0, None if i else "x") for i in range(5)], "doc_id long, pass boolean, system_errors string")
    path = W.write_verified(rows.repartition(3), str(tmp_path / "s.jsonl"))
    back = RD.json_records(spark, path, "doc_id long, pass boolean, system_errors string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_cutoff_of_a_collator(spark):
    """The cutoff per batch goes before the response cutoff; without either rows stay."""
    rows = spark.createDataFrame(
        [(b, k, [1] * (3 + 2 * k), [2] * (3 + 2 * k), 2) for b in range(6) for k in range(1, 5)], "b int, k int, input_ids array<int>, labels array<int>, prompt_len int"
    )
    sizes = lambda df: sorted((r.b, r.k, len(r.input_ids)) for r in df.collect())
    whole, per = sizes(rows), sizes(K.perbatch_cutoff(rows, "b", "k"))
    assert sizes(K.cut_batches(rows, "b", "k")) == whole
    assert sizes(K.cut_batches(rows, "b", "k", perbatch=True, ratio=1.0)) == per != whole
    always = sizes(K.cut_batches(rows, "b", "k", ratio=1.0))
    assert always == sizes(K.resp_cutoff(rows, "b", 1.0)) and always not in (whole, per)
    for ratio in (-0.1, 1.5):
        with pytest.raises(ValueError, match="ratio"):
            K.cut_batches(rows, "b", "k", ratio=ratio)


def test_loss_norm_kinds(spark):
    rows = spark.createDataFrame([(0, 3.0, 2), (0, 1.0, 0), (1, 0.0, 0)], "b int, nll_sum double, n_maskable int")
    got = {(r.b, r.kind): r.loss for r in N.loss_norm(rows, "b", *N.NORMS).collect()}
    assert got == {(0, "token"): 2.0, (0, "sequence"): 1.25, (0, "batch"): 2.0, (1, "token"): 0.0, (1, "sequence"): 0.0, (1, "batch"): 0.0}
    assert {r.b: r.loss for r in N.loss_norm(rows, "b", "sequence").collect()} == {0: 1.25, 1: 0.0}
    assert N.loss_norm(rows.limit(0), "b", *N.NORMS).count() == 0
    for kinds in ((), ("rows",)):
        with pytest.raises(ValueError, match="normalisation"):
            N.loss_norm(rows, "b", *kinds)
