"""The toxicity operator's parts against plain versions, and its edge cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalweave.llm import toxicity as T


def rows_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return rows.withColumns({c: F.lit(7) for c in ("toxic", "fired", "n", "name", "held_out", "score", "i", "clean")})


@pytest.fixture(scope="module")
def corpus(spark):
    """300 texts; toxic ones hold an insult that no lexicon has, and so does one that is not labelled so."""
    rng = random.Random(2)
    words = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(5, 30))] + (["zorgblat", "idiot"] if toxic else [])
        rng.shuffle(text)
        texts.append(" ".join(text))
        labels.append(int(toxic))
    return texts, labels


def table(spark, labels):
    return spark.createDataFrame([(i, 1, t) for i, t in enumerate(labels)], "doc_id long, quality int, toxic int")


def test_pairs_of_votes():
    lists = [[], [3], [1, 4], [0, 2, 5, 7], [], [1, 4, 6]]
    fired, row = np.array([v for f in lists for v in f]), np.repeat(np.arange(len(lists)), [len(f) for f in lists])
    got = sorted((r, i, j) for a in T._pairs(fired, row) for r, i, j in zip(*(x.tolist() for x in a)))
    assert got == [(r, f[x], f[y]) for r, f in enumerate(lists) for x in range(len(f)) for y in range(x + 1, len(f))]


def test_moments_against_plain_sums(monkeypatch):
    """Also where a task hands its pairs on after every few."""
    rng = random.Random(1)
    lists = [sorted(rng.sample(range(6), rng.randrange(5))) for _ in range(40)]
    label = [rng.choice([None, 0, 1]) for _ in lists]
    model = T.LabelModel(np.full(6, 0.4), np.linspace(0.05, 0.3, 6), 0.2, np.ones(6))
    want = defaultdict(lambda: np.zeros(2))
    for f, y in zip(lists, label):
        p = model.posterior(np.array(f, dtype=int), np.zeros(len(f), int), np.array([-1 if y is None else y]))[0]
        for key in [(-1, -1), *((i, i) for i in f), *((f[x], f[y]) for x in range(len(f)) for y in range(x + 1, len(f)))]:
            want[key] += (p, 1 - p)
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[k : k + 15], pa.list_(pa.int32())), pa.array(label[k : k + 15], pa.int32())], names=["fired", "toxic"]) for k in (0, 15, 30)]
    for held in (3, 10**6):
        monkeypatch.setattr(T, "HELD", held)
        got = defaultdict(lambda: np.zeros(2))
        for b in T._moments(model, True, 6)(iter(batches)):
            for i, j, on, off in zip(*(c.to_pylist() for c in b.columns)):
                got[i, j] += (on, off)
        assert {k for k, v in got.items() if v.any()} == set(want)
        for key, value in want.items():
            assert got[key] == pytest.approx(value)


def test_voters_are_those_of_all_labelled_rows(spark, monkeypatch, corpus):
    texts, labels = corpus
    monkeypatch.setattr(T, "HELD", 50)
    training = T._training(table(spark, labels))
    got = T.mine_voters(rows_of(spark, texts).select("doc_id", "text"), training).names
    known = {r["doc_id"]: r["toxic"] for r in training.collect()}
    assert 0 < len(known) < len(labels) and not any(r["doc_id"] in known for r in rows_of(spark, texts).filter(T.held_out()).collect())
    count = {0: Counter(), 1: Counter()}
    for i, y in known.items():
        count[y].update(T.patterns_of(T.words_of(texts[i])))
    bad, good = sum(known.values()), len(known) - sum(known.values())
    want = set("=" + w for w in T.LEXICON)
    for name, t in count[1].items():
        c, base = count[0][name], bad / (bad + good)
        p = t / (t + c)
        evidence = t * np.log(p / base) + (c * np.log((1 - p) / (1 - base)) if c else 0)
        if evidence >= T.EVIDENCE and t * good >= T.ODDS * c * bad and p > base:
            want.add(name)
    assert set(got) == want and len(got) == len(want) and "=zorgblat" in want


def test_scores(spark, corpus):
    texts, labels = corpus
    out = T.toxicity(rows_of(spark, texts), table(spark, labels)).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r["predicted"] == labels[r["doc_id"]] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1


def test_nulls_repeats_and_long_texts(spark, corpus):
    texts, labels = corpus
    extra = [None, "", "\n", "zorgblat idiot " * 50_000, texts[0], texts[0], "zorgblat"]
    docs = rows_of(spark, [*texts, *extra]).withColumn("doc_id", F.when(F.col("doc_id") < 305, F.col("doc_id")).otherwise(F.lit(None).cast("long")))
    out = T.toxicity(docs, table(spark, labels).union(table(spark, labels)).union(spark.createDataFrame([(None, 1, 1), (3, None, None), (9999, 0, 1)], "a long, b int, c int")))
    rows = out.collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == len(texts) + len(extra)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    silent = {by[300][0]["score"], by[301][0]["score"], by[302][0]["score"]}
    assert len(silent) == 1 and silent.pop() < 0.5 and by[303][0]["predicted"] == 1
    assert by[304][0]["score"] == by[0][0]["score"] and len(by[None]) == 2 and not any(r["held_out"] for r in by[None])


def test_no_rows_and_no_labels(spark, corpus):
    texts, labels = corpus
    none = table(spark, labels).limit(0)
    assert T.toxicity(rows_of(spark, texts).limit(0), table(spark, labels)).count() == 0
    assert T.toxicity(rows_of(spark, texts).limit(0), none).count() == 0
    out = {r["doc_id"]: r["score"] for r in T.toxicity(rows_of(spark, ["you idiot", "fine day", None]), none).collect()}
    assert out[0] > out[1] == out[2]
