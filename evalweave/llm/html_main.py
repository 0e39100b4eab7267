"""Main text of web pages by wrapper induction.

A page becomes a small block tree: block elements only, runs of like siblings folded
into one node. The trees of a host's different pages are aligned with up to REFERENCES
pages of the host by simple tree matching. Text that aligned nodes share on nearly all
pages is template, and a page loses a block only where its text there is the template's;
the others are slots. Two different pages are enough to tell; copies of a page count once.
The content is what article and main elements hold, or else the whole page, without
template and without the elements whose role is boilerplate. Elements that are boilerplate
by class, id or role only, and forms, stay nodes of their own: those that hold most of a
page's varying text are content, unless they are comments, adverts or menus.

Per host only counts for the nodes of its reference pages are kept, and they are summed
per task before they are shuffled; joins by host are salted, so a host with a third of all
pages is no hot spot.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.sources.scratch import materialize

CONSTANT = 0.9  # share of aligned pages with the same text that makes it template
LAYOUT = 0.25  # share of a host's pages that a template node is aligned on, at least
REFERENCES = 3  # pages of a host that the others are aligned with
MOST = 0.5  # share of a page's varying text above which an element is content whatever its class
DEEPEST = 512  # level of nesting below which blocks belong to the node above them
SALTS = 16  # tasks a host's pages go to

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
BOILERPLATE = frozenset(
    "nav header footer aside script style noscript template iframe svg button select textarea menu dialog object canvas head title".split()
)
ROLES = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement advertising banner promo promoted"
    " sponsor sponsored cookie cookies consent notice notices alert popup modal comments comment respond reply replies disqus share"
    " sharing social related recommended newsletter subscribe signup login search searchform breadcrumb breadcrumbs pagination pager"
    " widget toolbar copyright legal masthead contentinfo complementary".split()
)
#: Roles that say little on a paragraph, a heading or an inline element.
WEAK = frozenset("legal search header footer related recommended comment reply replies respond login signup menu widget".split())
#: Roles that are never content, however long.
NEVER = frozenset(
    "comment comments respond reply replies disqus ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent"
    " nav navbar navigation menu".split()
)
#: Parts of a class name beside which another part does not make a role.
OWN = frozenset("content article entry story text has no with without".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
CODE = frozenset(("pre", "code"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th img option".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table menu".split())
WHOLE = frozenset("html body article main".split())

# Quotes open only after "="; elsewhere they are characters of a name.
_REST = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+"
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?"
    rf"|<svg(?=[\s/>]){_REST}(?<=/)>"
    rf"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg)(?=[\s/>]){_REST}(?:\Z|>.*?(?:</(?P=raw)\s*+>|\Z))"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>{_REST})(?:>|\Z)",  # a tag that does not end is none of the text
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_SPACE = re.compile(r"\s+")


@dataclass
class Page:
    """keys and parents of the nodes, and the blocks (node, text) in page order."""

    keys: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def paths(self) -> list[str]:
        out = [""]
        for key, parent in zip(self.keys[1:], self.parents[1:], strict=True):
            out.append(f"{out[parent]}/{key}")
        return out


@lru_cache(maxsize=4096)
def _names(rest: str) -> tuple[str, ...]:
    """Classes, ids and roles of a tag, in lower case."""
    return tuple(w for m in _ATTRIBUTE.finditer(rest) if m[1].lower() in ("class", "id", "role") for w in (m[2] or m[3] or m[4] or "").lower().split())


@lru_cache(maxsize=4096)
def _role(rest: str, parts: bool, weak: bool) -> str:
    """The first class, id or role that is boilerplate, or nothing. With `parts` a part of a
    name at - and _ is enough; without `weak`, roles of WEAK do not count.
    """
    for name in _names(rest):
        if name in ROLES and (weak or name not in WEAK):
            return name
        own = re.split("[-_]+", name) if parts else ()
        if len(own) > 1 and OWN.isdisjoint(own):
            for w in own:
                if w in ROLES and not (w in ("header", "footer") and "post" in own):
                    return w
    return ""


def _label(tag: str, rest: str) -> str:
    """What tells a plain container from its like siblings: letters of its first class or id."""
    return re.sub("[^a-z]", "", next(iter(_names(rest)), ""))[:24] if tag in ("div", "section") else ""


def _marked(path: str) -> str:
    """The path down to the innermost element that is boilerplate by its class; empty if none."""
    at = path.rfind(".")
    return path[: (path + "/").index("/", at)] if at >= 0 else ""


def parse(source: str) -> Page:
    page = Page()
    depth = [0]
    last: list[dict[str, int]] = [{}]  # of each node, its latest child
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # element, node, inside boilerplate
    words: list[str] = []
    at = 0

    def end_block() -> None:
        if words:
            text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
            words.clear()
            if text:
                page.blocks.append((stack[-1][1], text))

    for m in _MARKUP.finditer(source):
        if m.start() > at and not stack[-1][2]:
            words.append(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if any(x[0] in BLOCKS for x in stack[k:]):
                        end_block()
                    del stack[k:]
                    break
                if not block and stack[k][0] in BLOCKS:
                    break
            continue
        if tag in SPACED:
            if not stack[-1][2]:
                words.append(" ")
            continue
        if not block and tag in VOID:
            continue
        role = ""
        if m["rest"] and tag not in WHOLE and (block or CODE.isdisjoint(x[0] for x in stack)):
            role = _role(m["rest"], block and tag not in TEXT, block and tag not in TEXT)
        if tag == "form":
            role = "form"
        if not block:
            boiler = stack[-1][2] or tag in BOILERPLATE or bool(role)
            if boiler and not stack[-1][2] and not m["rest"].endswith("/"):
                stack.append((tag, stack[-1][1], True))
            continue
        end_block()
        ends = CLOSES.get(tag, set()) | {"p"}
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in ends:
                del stack[k:]
            elif stack[k][0] in BLOCKS and (stack[k][0] in LISTS or stack[k][0] != "p"):
                break
        boiler = stack[-1][2] or tag in BOILERPLATE
        label = "" if role else _label(tag, m["rest"])
        key = f"{tag}.{role}" if role else f"{tag}:{label}" if label else tag
        if tag == "hr":
            continue
        parent = stack[-1][1]
        node = parent
        if not boiler and depth[parent] < DEEPEST:
            latest = last[parent]
            node = latest.get(key, -1)
            if node < 0 or latest.get(" ") != node:
                node = len(page.keys)
                page.keys.append(key)
                page.parents.append(parent)
                depth.append(depth[parent] + 1)
                last.append({})
                latest[key] = latest[" "] = node
        stack.append((tag, node, boiler))
    if at < len(source) and not stack[-1][2]:
        words.append(source[at:])
    end_block()
    return page


@lru_cache(maxsize=20_000)
def align(a: tuple[tuple[str, int], ...], b: tuple[tuple[str, int], ...]) -> tuple[tuple[int, int], ...]:
    """Pairs of nodes of two trees ((key, parent), ...) by simple tree matching: equal
    roots, and the heaviest order-keeping matching of their children.
    """
    kids = []
    for tree in (a, b):
        of: list[list[int]] = [[] for _ in tree]
        for i, (_, parent) in enumerate(tree):
            if parent >= 0:
                of[parent].append(i)
        kids.append(of)
    memo: dict[tuple[int, int], tuple[int, tuple]] = {}

    def match(x: int, y: int) -> tuple[int, tuple]:
        if a[x][0] != b[y][0]:
            return 0, ()
        if (x, y) not in memo:
            xs, ys = kids[0][x], kids[1][y]
            best: list[list[tuple[int, tuple]]] = [[(0, ())] * (len(ys) + 1) for _ in range(len(xs) + 1)]
            for i, p in enumerate(xs):
                for j, q in enumerate(ys):
                    w, pairs = match(p, q)
                    into = (best[i][j][0] + w, (best[i][j][1], pairs))
                    best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], into, key=lambda t: t[0])
            weight, chosen = best[-1][-1]
            memo[x, y] = weight + 1, ((x, y), chosen)
        return memo[x, y]

    out: list[tuple[int, int]] = []
    todo = [match(0, 0)[1]]
    while todo:
        t = todo.pop()
        if t and isinstance(t[0], int):
            out.append(t)
        else:
            todo.extend(t)
    return tuple(sorted(out))


def _tree(page: Page) -> tuple[tuple[str, int], ...]:
    return tuple(zip(page.keys, page.parents, strict=True))


def _sums(page: Page) -> list[int]:
    """Of each block the hash by which it is compared: of its own text, or of all text of its
    node where that is running text.
    """
    whole: dict[int, int] = {}
    own = []
    for node, text in page.blocks:
        data = text.encode("utf-8", "surrogatepass")
        if page.keys[node].partition(".")[0] in TEXT:
            whole[node] = crc32(data, whole.get(node, 0))
        own.append(crc32(data))
    return [whole.get(node, s) for (node, _), s in zip(page.blocks, own, strict=True)]


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for source in batch.column(1):
            page = parse(source.as_py() or "")
            held = sorted({(node, s) for (node, _), s in zip(page.blocks, _sums(page), strict=True)})
            out.append((page.keys, page.parents, [n for n, _ in held], [s for _, s in held]))
        columns = [pa.array([o[k] for o in out], pa.list_(t)) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["host", "keys", "parents", "nodes", "sums"])


def _by_node(nodes: list[int], sums: list[int]) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {}
    for n, s in zip(nodes, sums, strict=True):
        out.setdefault(n, set()).add(s)
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, ref, path, sum, seen, same): sums over a batch for the texts of the reference
    pages, `sum` being a text's hash. Path '' and sum -1 count all pages.
    """
    columns = ("host", "ref", "keys", "parents", "nodes", "sums", "ref_keys", "ref_parents", "ref_nodes", "ref_sums")
    for batch in batches:
        total: dict[tuple[str, int, str, int], list[int]] = {}
        rows = batch.to_pydict()
        for host, no, keys, parents, nodes, sums, rk, rp, rn, rs in zip(*(rows[c] for c in columns), strict=True):
            ref = Page(rk, rp)
            paths, theirs, own = ref.paths(), _by_node(rn, rs), _by_node(nodes, sums)
            total.setdefault((host, no, "", -1), [0, 0])[0] += 1
            for x, y in align(_tree(ref), tuple(zip(keys, parents, strict=True))):
                for s in theirs.get(x, ()):
                    t = total.setdefault((host, no, paths[x], s), [0, 0])
                    t[0] += 1
                    t[1] += s in own.get(y, ())
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in total], t) for i, t in enumerate(kinds)), *(pa.array([v[i] for v in total.values()], pa.int64()) for i in range(2))],
            names=["host", "ref", "path", "sum", "seen", "same"],
        )


def main_text(source: str, template: frozenset[tuple[str, int]] = frozenset()) -> str:
    """Main text of a page, given its host's template: (path, hash of the text)."""
    page = parse(source)
    paths = page.paths()
    marks = [_marked(p) for p in paths]
    sums = _sums(page)
    varies = [(paths[k], s) not in template for (k, _), s in zip(page.blocks, sums, strict=True)]
    mass: dict[str, int] = {}
    running: set[str] = set()  # marked elements with running text
    for (k, text), own in zip(page.blocks, varies, strict=True):
        mass[marks[k]] = mass.get(marks[k], 0) + len(text) * own
        if page.keys[k] in TEXT:
            running.add(marks[k])
    bulk = max(mass, key=lambda m: mass[m], default="")
    role = bulk.rpartition(".")[2]
    content = {""}
    if mass.get(bulk, 0) > MOST * sum(mass.values()) and (role not in NEVER or not mass.get("")) and (role != "form" or bulk in running):
        content.add(bulk)
    chosen = {k for k, m in enumerate(marks) if m in content}
    main = {k for k in chosen if "/main/" in paths[k] + "/"}
    article = {k for k in chosen if "/article/" in paths[k] + "/"}
    held = lambda some: sum(len(t) for k, t in page.blocks if k in some)
    if main and 2 * held(main) >= held(main | article):
        chosen = main
    elif held(main | article):
        chosen = main | article
    kept = [(t, own) for (k, t), own in zip(page.blocks, varies, strict=True) if k in chosen]
    # A page that is a template as a whole is content all the same.
    return "\n".join(t for t, own in kept if own or not any(o for _, o in kept))


def extract_main(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page (page_id, url, html).

    NULL or empty html has an empty text. Pages without a host share one (empty) host; a host
    with one page, or copies of one only, has no template. Repeated rows stay; an empty table
    gives an empty result; other columns are ignored.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    parts = "keys array<string>, parents array<int>, nodes array<int>, sums array<bigint>"
    skeletons = materialize(
        rows.select("host", "html").mapInArrow(_skeletons, f"host string, {parts}")
        .withColumn("pick", F.xxhash64("keys", "nodes", "sums")).dropDuplicates(["host", "pick"])
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    ref = F.pmod("pick", F.lit(REFERENCES)).cast("int").alias("ref")
    picks = skeletons.groupBy("host", ref).agg(F.min("pick").alias("pick"))
    refs = skeletons.join(picks, ["host", "pick"]).select("host", "ref", *(F.col(c).alias(f"ref_{c}") for c in ("keys", "parents", "nodes", "sums")), salts)
    counts = (
        skeletons.withColumn("salt", F.pmod(F.shiftright("pick", 8), F.lit(SALTS)).cast("int")).join(refs, ["host", "salt"])
        .mapInArrow(_aligned, "host string, ref int, path string, sum bigint, seen bigint, same bigint")
        .groupBy("host", "ref", "path", "sum").agg(F.sum("seen").alias("seen"), F.sum("same").alias("same"))
    )
    # One row a host, with an entry for each constant text of its reference pages.
    by_host = counts.groupBy("host").agg(
        F.max(F.when(F.col("sum") == -1, F.col("seen"))).alias("pages"),
        F.collect_list(F.when((F.col("sum") >= 0) & (F.col("seen") > 1) & (F.col("same") >= CONSTANT * F.col("seen")), F.struct("path", "sum", "seen"))).alias("constant"),
    )
    hosts = materialize(by_host.select("host", F.array_distinct(F.expr(f"transform(filter(constant, c -> c.seen >= {LAYOUT} * pages), c -> struct(c.path, c.sum))")).alias("template")))

    page_id = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(h or "", frozenset((n["path"], n["sum"]) for n in template or ()))
                for h, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    salt = F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int").alias("salt")
    return (
        rows.select("*", salt).join(hosts.select("host", "template", salts), ["host", "salt"], "left")
        .select("page_id", "url", "html", "template").mapInArrow(run, f"page_id {page_id}, url string, text string")
    )
