"""URL verdicts from rules, and from trust and distrust carried over the host graph.

Rules decide the pages they fit. Each host starts with the share of its pages that rules
allow (trust) and block (distrust); a host without pages with that share of the urls that
link to it, a parent domain without either with the rules of its root. A score keeps its
start and fills the rest, damped, with what links bring. Trust runs along links, shared out
among the hosts a host links to. Distrust runs along reversed links, to the hosts that point
at blocked ones, as the mean over a host's own links, so it does not depend on how many
others point there. A page without a rule is blocked when its host's distrust reaches a
threshold and exceeds its trust.

Edges are links between hosts, read from the html, and the tie of a host to its parent
domain; neither end needs pages. Parents are domains of two labels at least, and any that
occur. All ties of a parent to its hosts weigh as one link, as does each host's to it.
Scores and edges are tables; every step is a join and a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.sources.scratch import materialize

DAMPING = 0.85
STEPS = 12  # of propagation; what is left after them weighs less than DAMPING ** STEPS
DISTRUST = 0.5  # at which a host without a rule is blocked

#: (host suffix, path start, verdict). Fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?(//[^/?#"'\s>]+[^?#"'\s>]*)"""


def lower_az(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where it is NULL or has no `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_az(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; NULL where none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    order = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    text = verdict = None
    for name, start, outcome in order:
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        text = F.when(fits, F.lit(name + start)) if text is None else text.when(fits, F.lit(name + start))
        verdict = F.when(fits, F.lit(outcome)) if verdict is None else verdict.when(fits, F.lit(outcome))
    return text, verdict


def page_links(pages: DataFrame) -> DataFrame:
    """(src, urls) of pages with links: their distinct targets without scheme and query."""
    urls = F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))
    return pages.select(F.col("host").alias("src"), urls.alias("urls")).filter("src <> '' AND size(urls) > 0")


def host_edges(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, w): links between hosts, weighed by pages, and host <-> parent domain."""
    host = lambda u: lower_az(F.regexp_extract(u, "^//([^/]+)", 1))
    found = links.select("src", F.explode(F.array_distinct(F.transform("urls", host))).alias("dst")).filter("src <> dst")
    linked = found.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    known = hosts.select("host").union(linked.select("dst")).distinct()
    up = known.select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst")).filter(r"src <> dst AND dst <> '' AND NOT src RLIKE '^[0-9.]+(:[0-9]+)?$'")
    up = up.join(known.select(F.col("host").alias("dst"), F.lit(True).alias("occurs")), "dst", "left").filter("occurs OR dst LIKE '%_.%'").select("src", "dst")
    kids = up.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    down = up.join(kids, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (1 / F.col("n")).alias("w"))
    return linked.union(up.withColumn("w", F.lit(1.0))).union(down).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def host_seeds(hosts: DataFrame, links: DataFrame, edges: DataFrame, rules=RULES) -> DataFrame:
    """(host, good, bad) of every node: from its pages, else from the urls that link to it,
    else from the rules of its root.
    """
    urls = links.select(F.explode("urls").alias("url")).distinct()
    host, path = url_parts(F.concat(F.lit(":"), F.col("url")))
    linked = urls.select(host.alias("host"), F.when(path == "", "/").otherwise(path).alias("path")).distinct()
    roots = edges.select(F.col("dst").alias("host"), F.lit("/").alias("path")).distinct().join(linked.select("host").distinct(), "host", "left_anti")
    others = linked.union(roots).join(hosts, "host", "left_anti")
    return hosts.select("host", "good", "bad").union(others.groupBy("host").agg(*shares(rule_of(F.col("host"), F.col("path"), rules)[1])))


def shares(ruled: Column) -> tuple[Column, Column]:
    """Shares of rows that rules allow (good) and block (bad)."""
    share = lambda v: F.avg(F.when(ruled == v, 1.0).otherwise(0.0))
    return share("allow").alias("good"), share("block").alias("bad")


def propagate(seeds: DataFrame, shares: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """(host, x): x = seed + (1 - seed) * damping * sum of p * x over the shares (src, dst, p)
    that come to it.
    """
    state = materialize(seeds.select("host", "seed", F.col("seed").alias("x")))
    if not shares.limit(1).count():
        return state.select("host", "x")
    for _ in range(steps):
        comes = state.filter("x > 0").join(shares, F.col("host") == F.col("src")).groupBy("dst").agg(F.sum(F.col("x") * F.col("p")).alias("y"))
        x = F.col("seed") + (1 - F.col("seed")) * damping * F.coalesce("y", F.lit(0.0))
        state = materialize(state.join(comes, state["host"] == comes["dst"], "left").select("host", "seed", x.alias("x")))
    return state.select("host", "x")


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = DISTRUST) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page (page_id, url, html).

    NULL urls and urls without a host have an empty host, no trust and no distrust: allowed.
    NULL html has no links. Repeated rows count each; an empty table gives an empty result;
    other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = (
        pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
        .withColumn("rule", text).withColumn("ruled", verdict)
    )
    hosts = materialize(rows.filter("host <> ''").groupBy("host").agg(*shares(F.col("ruled"))))
    links = materialize(page_links(rows))
    edges = materialize(host_edges(links, hosts))
    seeds = materialize(host_seeds(hosts, links, edges, rules))
    out = edges.groupBy("src").agg(F.sum("w").alias("all"))
    share = materialize(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("all")).alias("p")))
    trust = propagate(seeds.select("host", F.col("good").alias("seed")), share).withColumnRenamed("x", "trust")
    back = share.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "p")
    distrust = propagate(seeds.select("host", F.col("bad").alias("seed")), back).withColumnRenamed("x", "distrust")
    scores = trust.join(distrust, "host")
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    judged = rows.drop("html").join(scores, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust"
    )
