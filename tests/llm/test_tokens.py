"""Packing, alignment of tokenizers and spelling variants against plain versions."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalweave.llm import alignment, coders, packing, queries, spelling
from evalweave.sources.scratch import materialize

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", "x", " x", "x ", "a  b   c", "tab\tthere\n\nnew  line", "don't we'll 'tis", "a▁b c", "▁", "日本語 🎉 text",
    "<|endoftext|> a <|endoftext|>", "<s> </s> <unk> <0x0A>", "nul\x00byte", "ﬁ ① Å é  em", "word " * 3000, "ab" * 20000, "end. Next, 12 34th A1 b2",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Texts of every kind, two of them twice, with columns that the operators use inside."""
    rows = [(i, t) for i, t in enumerate([*ODD, "x", "a▁b c"])] + [(None, "no key here")]
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    return rows.withColumns({c: F.lit(7) for c in ("key", "ids", "part", "before", "n", "word", "a", "b", "_row", "groups", "block")})


@pytest.fixture(scope="module")
def given(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def test_ids_are_those_of_the_library():
    """The coder of ranks against the file's own library, special tokens read as such or as text."""
    rng = random.Random(6)
    some = ["the", "Straße", "it's", "x.", "12", "3rd", "\n", "\t", " ", "'ll", "don't", "▁", "日本", "-", "a", "<|endoftext|>", "\u00a0", "é", "ʼ"]
    letters = "abdeghinorstuüßéèñç "
    texts = ["".join(rng.choice([*some, " ", " "]) for _ in range(rng.randrange(30))) for _ in range(2000)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(2000)] + [t for t in ODD if t]
    with open(A_PATH, encoding="utf-8") as f:
        model = f.read()
    for as_text in (True, False):
        tokenizer = Tokenizer.from_str(model)
        tokenizer.encode_special_tokens = as_text
        flat, n = coders.byte_bpe(model, as_text)(texts)
        at = np.concatenate(([0], np.cumsum(n)))
        for k, t in enumerate(texts):
            assert flat[at[k] : at[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("change", ["merges", "normalizer", "pre_tokenizer", "added"])
def test_other_files_are_left_to_their_library(change):
    with open(A_PATH, encoding="utf-8") as f:
        model = json.load(f)
    assert coders._ranks(model) is not None
    if change == "merges":
        model["model"]["merges"][500:502] = model["model"]["merges"][501:499:-1]
    elif change == "normalizer":
        model["normalizer"] = {"type": "Lowercase"}
    elif change == "pre_tokenizer":
        model["pre_tokenizer"]["add_prefix_space"] = True
    else:
        model["added_tokens"][0]["lstrip"] = True
    assert coders._ranks(model) is None
    texts = ["Some Text <|endoftext|> here", "", "x"]
    flat, n = coders.byte_bpe(json.dumps(model))(texts)
    library = Tokenizer.from_str(json.dumps(model))
    assert flat.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids] and len(n) == 3


# ---- packing ---------------------------------------------------------------------


def check_packed(rows, texts, length=packing.LENGTH):
    """Pieces against each text's ids by the library: contiguous, equal, and gapless sequences."""
    tokenizer = Tokenizer.from_file(A_PATH)
    want = Counter()
    for key, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[key, ids.tobytes()] += 1
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == length or (s == len(by_sequence) - 1 and 0 < at < length)
    got, open_ = Counter(), {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        before, ids = open_.pop(r["doc_id"], (0, b"")) if r["start"] else (0, b"")
        assert r["start"] == before and len(r["ids"]) == 4 * r["length"] > 0
        ids += bytes(r["ids"])
        if len(ids) == 4 * r["doc_tokens"]:
            got[r["doc_id"], ids] += 1
        else:
            open_[r["doc_id"]] = (before + r["length"], ids)
    assert not open_ and got == want


@pytest.mark.parametrize("length", [1024, 7, 1])
def test_pack(spark, odd, length):
    rows = packing.pack(odd.repartition(5), A_PATH, length)
    check_packed(rows.collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], length)


def test_pack_given(given):
    rows = packing.pack(given.repartition(9), A_PATH).collect()
    check_packed(rows, [tuple(r) for r in given.collect()])


def test_pack_with_joined_offsets(monkeypatch, given):
    monkeypatch.setattr(packing, "FEW", 0)
    monkeypatch.setattr(packing, "BLOCK", 2)
    monkeypatch.setattr(packing, "OUT_IDS", 50)
    rows = packing.pack(given.limit(60).repartition(7), A_PATH, 100).collect()
    assert max(r["sequence_id"] for r in rows) == -(-sum(r["length"] for r in rows) // 100) - 1


def test_pack_sequences(given):
    packed = materialize(packing.pack(given.limit(30).repartition(3), A_PATH, 64))
    rows = packing.sequences(packed).orderBy("sequence_id").collect()
    assert all(len(r["ids"]) == 4 * 64 for r in rows[:-1])
    for r in rows:
        assert [b["offset"] for b in r["boundaries"]][0] == 0
        assert sum(b["length"] for b in r["boundaries"]) * 4 == len(r["ids"])


def test_pack_nothing(odd):
    assert packing.pack(odd.limit(0), A_PATH).count() == 0


def test_pack_query(spark, sf, given):
    rows = queries.op12(spark, sf).collect()
    tokenizer = Tokenizer.from_file(A_PATH)
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in given.collect()}
    for r in rows:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


# ---- alignment -------------------------------------------------------------------


def plain_alignment(rows):
    """key -> list of the contract's values, token by token."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    names = alignment.byte_level_tokens(a)

    def piece(i):
        n = b.id_to_piece(i)
        return bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode()

    found, count = [], Counter()
    for key, text in rows:
        links, groups = [], []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            whole = (" " + text).encode()
            if b"".join(names[i] for i in x) == whole == b"".join(map(piece, y)):
                owner = lambda ids, size: [k for k, i in enumerate(ids) for _ in range(size(i))]
                of_a, of_b = owner(x, lambda i: len(names[i])), owner(y, lambda i: len(piece(i)))
                pairs = sorted(set(zip(of_a, of_b)))
                links = [(x[i], y[j]) for i, j in pairs]
                cut = [k for k in range(1, len(whole) + 1) if k == len(whole) or (of_a[k] != of_a[k - 1] and of_b[k] != of_b[k - 1])]
                for lo, hi in zip([0, *cut], cut):
                    groups.append((sorted(set(of_a[lo:hi])), sorted(set(of_b[lo:hi]))))
                groups = ["|".join((",".join(str(x[i]) for i in g), ",".join(str(y[j]) for j in h))) for g, h in groups]
                found.append((key, len(x), len(y), groups, links))
                count.update(set(links))
                continue
        found.append((key, 0, 0, groups, links))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return [
        (key, n_a, n_b, len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for key, n_a, n_b, groups, links in found
    ]


def aligned(docs, held):
    rows = alignment.align(docs, A_PATH, B_PATH)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("digest")
    stored = materialize(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"))
    out = alignment.with_counts(stored, held)
    return [tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest").collect()]


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("held", [1 << 20, 20, 1])
def test_alignment(odd, held):
    """Whether a task holds all counts, a few or one."""
    want = plain_alignment([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert by_key(aligned(odd.repartition(4), held)) == by_key(want)


def test_alignment_given(spark, sf, given):
    rows = queries.op13(spark, sf).collect()
    want = plain_alignment([tuple(r) for r in given.collect()])
    assert by_key(tuple(r) for r in rows) == by_key(want)


def test_alignment_nothing(odd):
    assert aligned(odd.limit(0), 10) == []


def test_partial_counts(monkeypatch, given):
    rows = materialize(alignment.align(given, A_PATH, B_PATH))
    want = sorted(map(tuple, alignment.pair_counts(rows).collect()))
    monkeypatch.setattr(alignment, "PARTIAL", 100)
    monkeypatch.setattr(alignment, "LINKS", 1000)
    assert sorted(map(tuple, alignment.pair_counts(rows).collect())) == want


# ---- spelling ---------------------------------------------------------------------


def plain_words(rows):
    count = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_apart(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    if len(x) > len(y):
        x, y = y, x
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def plain_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def variants(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumns({c: F.lit(1) for c in ("block", "tile", "form", "root")})
    rows = [tuple(r) for r in spelling.spelling_variants(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_words(spark, given, odd):
    texts = ["ÀÉÎ Straße STRASSE ×÷ÿ naïve Naïve NAÏVE", "x" * 5000, "Word word WORD wörd " * 200]
    extra = spark.createDataFrame([(k, t) for k in range(300) for t in texts], "doc_id long, text string")
    for docs in (given, odd, extra):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert dict(map(tuple, spelling.counted_words(docs).collect())) == plain_words(rows)


def test_variants_random(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeé×") for _ in range(rng.randrange(5, 9))) for _ in range(150)]
    words = {w: rng.choice([3, 3, 6, 12, 24, 1000]) for w in base}
    for w in base:
        k = rng.randrange(len(w))
        for v in (w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + "q" + w[k + 1 :], w[1:] + w[0]):
            if len(v) >= 5:
                words[v] = rng.choice([3, 6, 7, 14, 50])
    assert variants(spark, words) == plain_variants(words)


def test_variants_long_chains_and_ties(spark):
    chain = {"aaaaa" + "b" * k: 3 * 2**k for k in range(20)}
    ties = {"abcdef": 3, "abcdeg": 6, "abcdeh": 6, "xbcdef": 6}
    long = {"q" * 40_000: 3, "q" * 39_999 + "r": 9, "q" * 40_001: 5}
    words = chain | ties | long
    got = variants(spark, words)
    assert got == plain_variants(words)
    assert ("aaaaa", "aaaaab", "aaaaa" + "b" * 19, 3, 1, 6) in got


def test_variants_small_tiles(monkeypatch, spark):
    monkeypatch.setattr(spelling, "TILE", 40)
    monkeypatch.setattr(spelling, "ROWS", 3)
    monkeypatch.setattr(spelling, "CHECKED", 5)
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(5, 9))): rng.randrange(3, 60) for _ in range(300)}
    assert variants(spark, words) == plain_variants(words)


def test_variants_nothing(spark):
    assert variants(spark, {"alone": 3}) == {("alone", None, "alone", 3, 0, None)}
    df = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_variants(df).count() == 0
    assert spelling.counted_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_variants_query(spark, sf, given):
    got = {tuple(r) for r in queries.op11(spark, sf).collect()}
    words = plain_words([tuple(r) for r in given.collect()])
    assert got == plain_variants(words)
