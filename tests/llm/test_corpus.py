"""Corpus operators on small rows, against plain versions: NULLs, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names.
"""

import hashlib
import math
import re

import pytest
import tiktoken
import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from evalweave.llm import bpe, latent, licenses, queries
from evalweave.llm.disclosure import personal_spans, sanitise, with_base_spans, digest
from evalweave.llm.hilbert import hilbert_shards
from evalweave.llm.hostgraph import judge_urls
from evalweave.llm.html_main import align, extract_main
from evalweave.llm.jaccard import near_duplicates
from evalweave.llm.topk import top_k

WORDS = [f"w{i}" for i in range(40)]
BASE = " ".join(WORDS)
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("w39", "x")), (4, None), (5, ""), (6, "one two"), (7, "ONE  two"), (8, "é" * 30_000),
    (9, " ".join(reversed(WORDS))), (10, "Released under the MIT License. apache\nlicense mit license"), (11, "mail a.b@c.de, call +1 (017) 555-7713 or 10.0.0.255"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, "z", 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, h int, spans string, n int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(docs, none):
    got = [tuple(r) for r in near_duplicates(docs).collect()]
    want = brute_components(TEXTS)
    assert sorted(got) == sorted((i, *want[i]) for i, _ in TEXTS)
    assert near_duplicates(none).count() == 0


def test_jaccard_groups(spark):
    """Many variants of one text and texts that share a long passage."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(k, " ".join(w if (k * 7 + j) % 61 else f"v{k}" for j, w in enumerate(WORDS * 2))) for k in range(60)]
    rows += [(100 + k, passage + " " + " ".join(f"q{k}_{j}" for j in range(3 + k % 40))) for k in range(60)]
    got = {r[0]: (r[1], r[2]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows)


def test_bpe(docs, none):
    path = P.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in bpe.encode(docs, path, P.PATTERN, keep=("doc_id", "text")).collect():
        assert r.ids == plain.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encode(none, path, P.PATTERN).count() == 0


def test_licences(docs, none):
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    r = got[10]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (9, 3, 3, 7, "apache,mit")
    assert got[4].n_words == 0 and got[4].first_word is None and got[4].labels == "" and got[5].score == 0
    assert licenses.license_scan(none).count() == 0
    assert licenses.parse("MIT OR Apache-2.0 AND GPL-2.0 WITH X") == ["MIT", "Apache-2.0", "GPL-2.0", "X", "with", "and", "or"]
    assert licenses.parse("(MIT OR") is None
    assert licenses.evaluate(licenses.parse("(MIT OR GPL-2.0-only)")) == ({"mit", "gpl"}, 0.1)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                  "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_personal_spans(spark, docs, none):
    import random

    draw = random.Random(5)
    texts = ["".join(draw.choice(chars) for _ in range(50)) for chars in ("a1.2@- +()5_%é", "0123456789 -", "01234.56789..", "a.@b-") for _ in range(200)]
    texts += [t or "" for _, t in TEXTS] + ["4111 1111 1111 1111", "1 " * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for i, spans in with_base_spans(rows).select("doc_id", digest(F.col("base"))).collect():
        assert spans == plain_spans(texts[i]), texts[i]
    marked = personal_spans(docs)
    clean = {r[0]: r[1] for r in marked.select("doc_id", sanitise(F.col("text"), F.col("spans"))).collect()}
    assert clean[11] == "mail [EMAIL], call [PHONE] or [IP]" and clean[4] is None and clean[1] == BASE
    assert marked.count() == len(TEXTS) and personal_spans(none).count() == 0


def test_disclosing_term(spark):
    rows = [(i, f"alpha{chr(97 + i)} betta kestrel a@b.cd gamma{chr(97 + i)} delta") for i in range(4)]
    rows += [(10 + i, f"betta delta words of {chr(97 + i)} other kind") for i in range(20)]
    got = {r.doc_id: [s.value for s in r.spans if s.kind == "term"] for r in personal_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] == [""] and got[10] == []  # only `kestrel` always stands beside the address


def test_leaks(spark, docs, none):
    item = " ".join(f"item{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny")], "item_id bigint, text string")
    changed = " ".join(w if k % 7 else f"other{k}" for k, w in enumerate(item.split()))
    rows = [(1, f"start {item.upper()} end"), (2, f"some {changed} more"), (3, " ".join(item.split()[:9])), (4, None), (5, "nothing"), (None, item), (1, item)]
    got = sorted((r.doc_id, r.item_id) for r in latent.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect())
    assert got == [(1, 1), (2, 1)]
    assert latent.leaks(none, bench).count() == 0 and latent.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_parts(spark):
    """Heads, middles, tails and scattered words of an item, from 72 to 90 % of it."""
    items = [[f"own{i}x{k}" if k % 4 else f"common{k % 8}" for k in range(25 + 5 * i)] for i in range(6)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    rows, want = [], set()
    for i, w in enumerate(items):
        for share in (0.72, 0.8, 0.9):
            n = math.ceil(share * len(w))
            parts = [w[:n], w[(len(w) - n) // 2 :][:n], w[-n:], [x for k, x in enumerate(w) if (k + 1) * (len(w) - n) // len(w) == k * (len(w) - n) // len(w)]]
            for part in parts:
                want.add((len(rows), i))
                rows.append((len(rows), f"words before common1 {' '.join(part)} words after common3"))
        rows.append((len(rows), f"too little {' '.join(w[-(len(w) * 6 // 10) :])} of it"))
    got = {(r.doc_id, r.item_id) for r in latent.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == want


def test_lcs():
    import numpy as np

    assert latent.lcs(np.array([1, 2, 3, 4]), np.array([2, 9, 4, 1])) == 2 and latent.lcs(np.array([1]), np.array([], dtype=int)) == 0


def test_shards(docs, none):
    rows = hilbert_shards(docs).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(16)]
    assert len(rows) == len(TEXTS) and max(sizes) - min(sizes) <= 1
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert {r.doc_id: r.size for r in rows}[4] == 1 and hilbert_shards(none).count() == 0


def test_urls(spark):
    link = '<a href="https://bad.net/x">x</a>'
    rows = [
        (1, "http://a.net/x", ""), (2, "https://s.example.net/en/1?q", ""), (3, "http://x.example.com/de/1", ""), (4, "http://x.org/fr/", ""), (5, None, None),
        (6, "no scheme", ""), (7, "http://Bad.NET#t", ""), (8, "http://farm.com/", link), (9, "http://good.com/", ""), (10, "http://bad.net/", ""),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1][2:] == ("net/", "block") and got[2][2:] == ("example.net/en/", "allow") and got[3][2:] == ("example.com/de/", "block")
    assert got[4] == ("x.org", "/fr/", "org/fr/", "allow") and got[5] == ("", "", None, "allow") and got[6][0] == ""
    assert got[7][:3] == ("bad.net", "", None) and got[9][3] == "allow"


def test_urls_over_links(spark):
    """Blocked hosts without pages, many linkers of one, siblings, protocol-relative links."""
    bad, relative = '<a class="x" href="https://bad.net/x?q">x</a>', "<A HREF='//worse.NET/'>x</A>"
    rows = [(1, "http://farm.com/", bad), (2, "http://other.com/a", relative), (3, "http://good.com/", '<a href="http://fine.com/">x</a>' * 3), (4, "http://fine.com/", None)]
    rows += [(10 + k, f"http://l{k}.info/", bad) for k in range(30)]  # distrust is not split among them
    rows += [(50 + k, f"http://s{k}.farm2.com/", bad if k else "") for k in range(4)]  # s0 has no link but its siblings
    rows += [(60, "http://mixed.com/", bad + "".join(f'<a href="http://fine{k}.com/">x</a>' for k in range(5)))]
    rows += [(70, "http://paths.com/", '<a href="http://a.example.com/de/1">x</a>'), (71, "http://paths2.com/", '<a href="http://b.example.com/fr/1">x</a>')]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    blocked = {i for i, r in got.items() if r.verdict == "block"}
    assert blocked == {1, 2, 70, *range(10, 40), *range(51, 54)}
    assert got[51].distrust > got[50].distrust > 0.4  # by its parent, which has no page
    assert got[60].distrust > 0 and got[4].distrust == 0 and all(r.trust == 0 for r in got.values())


def test_html(spark):
    body = "<article><h1>T &amp; x</h1><p>one <b>two<br>three</p><div class='ad'>buy</div><p> four</article>"
    page = "<html><head><title>t</title><script>if(a<b)</script></head><body><nav><ul><li>m</ul></nav>{}<div id=comments>c</div><footer>f</footer>"
    plain = "<body><div class=menu>m</div><div><h2>head{}</h2><p>long text number {} with many words</p></div><div><p>same</p></div></body>"
    rows = [(1, "http://h/1", page.format(body)), (2, None, None), (3, "x", ""), (4, "http://h/2", "<p>" + "y " * 50_000)]
    rows += [(10 + k, "http://g/", plain.format(k, k * 7)) for k in range(12)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extract_main(frame).collect()}
    assert got[1] == "T & x\none two three\nfour" and got[2] == "" and got[3] == "" and len(got[4]) == 99_999
    assert got[13].startswith("head3\nlong text number 21")
    assert extract_main(frame.limit(0)).count() == 0
    assert align((("", -1), ("p", 0), ("ul", 0)), (("", -1), ("ul", 0))) == ((0, 0), (2, 1))


def test_html_own_text_at_template_paths(spark):
    """A page keeps what differs from its host's template, whatever the share of copies."""
    page = "<body><article><h1>{}</h1><p>{}</p><ul>{}</ul></article></body>"
    items = lambda k: "".join(f"<li>point {k} {j} of a list</li>" for j in range(9))
    rows = [(k, "http://copies/", page.format("one head", "one text", "<li>one list")) for k in range(19)] + [(19, "http://copies/", page.format("own head", "own text", items(0)))]
    rows += [(100 + k, "http://heads/", page.format("one head" if k else "own head", f"text {k} of many words", items(k))) for k in range(20)]
    got = {r.page_id: r.text for r in extract_main(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[19].startswith("own head\nown text\npoint 0 0") and got[100].startswith("own head\ntext 0")
    assert got[3] == "one head\none text\none list" and "text 7 of many words" in got[107]


def test_html_without_article(spark):
    """Nothing goes for its share of text, for a part of a class name, or with the bulk of the text."""
    words = lambda k, n: " ".join(f"word{k}x{j}" for j in range(n))
    beside = "<body><h1>head {0}</h1><div><p>lead {0}</p><p>{1}</p><section><p>{2}</p></section></div><div class='x ad'>buy {0}</div><p>same on all</p></body>"
    part = "<body><div class='content has-sidebar' data-id=share><p>own {0} {1}</p></div><div id='post-with-comments'><p>more {0}</p></div><div class=Sidebar>links {0}</div></body>"
    whole = "<body><div class='widget'><h2>title {0}</h2><p>{2}</p><div class='ad'>buy {0}</div></div><p>short {0}</p><div class='comments'><p>said {0}</p></div></body>"
    rows = [(100 * n + k, f"http://h{n}/", p.format(k, words(k, 8), words(k, 60))) for n, p in enumerate((beside, part, whole)) for k in range(20)]
    rows += [(300, "http://one/", whole.format(0, "", words(0, 60)))]
    got = {r.page_id: r.text for r in extract_main(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(20):
        assert got[k] == f"head {k}\nlead {k}\n{words(k, 8)}\n{words(k, 60)}"
        assert got[100 + k] == f"own {k} {words(k, 8)}\nmore {k}"
        assert got[200 + k] == f"title {k}\n{words(k, 60)}\nshort {k}"
    assert got[300] == f"title 0\n{words(0, 60)}\nshort 0"


def test_top_k(spark):
    rows = [(k, [k % 7 / 10, -k / 50, 0.3]) for k in range(300)] + [(5, [0.5, -0.1, 0.3]), (600, None), (700, [float("nan"), 1.0, 1.0]), (800, [None, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(frame, F.col("vec_id") % 100 == 0).collect()}
    import math

    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows[:301]]
    for q, v in whole:
        if q % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q))[:10]
            assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in best]
    assert top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_of_large_components(spark):
    """Sums past 62 bits are exact; scores or components that 64 bits cannot hold are errors."""
    import random

    rng = random.Random(4)
    near = [(i, [rng.choice([-1, 1]) * rng.uniform(1e6, 1.9e6) for _ in range(3)]) for i in range(60)]
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in near}
    frame = spark.createDataFrame(near, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(frame, F.col("vec_id") < 3, 5).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(3):
        order = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(order)]
    assert got == want and max(abs(w[3]) for w in want) > 2**62
    for big in (1e8, 1e17):
        with pytest.raises(Exception, match="64 bits"):
            top_k(spark.createDataFrame([(0, [big]), (1, [big])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op3_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    pairs = [(a.score, b.score) for a in rows if a.toxic == 1 for b in rows if b.toxic == 0]
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) > 0.8


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and all(r.exact and len(r.ids) == r.n_tokens for r in out)
    plain = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    roots = {c for _, c in brute_components(plain.items()).values()}
    assert {r.doc_id for r in out} <= set(plain) and len(out) <= len(roots)
    assert len({hashlib.sha256(str(r.ids).encode()).digest() for r in out}) >= len(out) - 2


def test_components_of_chains_stars_and_further_links(spark):
    from evalweave.llm.components import components, extended

    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    first = components(spark.createDataFrame(chain + star + star, "a long, b long"))
    assert {(r["id"], r["root"]) for r in first.collect()} == {(i, 0) for i in range(301)} | {(1000 + i, 1000) for i in range(50)}
    more = extended(first, spark.createDataFrame([(300, 1049), (5000, 4999), (7, 7)], "a long, b long"))
    assert sorted((r["id"], r["root"]) for r in more.collect()) == sorted([(i, 0) for i in [*range(301), *range(1000, 1050)]] + [(4999, 4999), (5000, 4999)])
    none = components(spark.createDataFrame([], "a long, b long"))
    assert none.count() == 0 and extended(none, spark.createDataFrame([(2, 1)], "a long, b long")).count() == 2


def test_large_groups_of_copies_change_nothing(spark, monkeypatch):
    """Copies with a large share of the rows get the places that small groups get."""
    from evalweave.llm import hilbert

    docs = [(k, "same text" if k % 3 else f"text {k}", "en" if k % 2 else "de", f"s{k % 5}", k) for k in range(300)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = []
    for hot in (0, 4096):
        monkeypatch.setattr(hilbert, "HOT", hot)
        out.append(sorted(tuple(r) for r in hilbert_shards(docs).collect()))
    assert out[0] == out[1] and len(out[0]) == 300
