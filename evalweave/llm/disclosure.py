"""Information-theoretic sanitisation of personal data, in DataFrame expressions only.

Protected entities are e-mail addresses, network addresses, card and phone numbers. A term
that occurs near one of them reveals it as far as corpus co-occurrence says so: the disclosure of term t about entity e is PMI(e; t) / IC(e),
1 where every text with t holds e beside it. Terms at or above a threshold are spans too:
generalised, or removed where the disclosure is full.

Only pairs of an entity and the words around it are shuffled. A term needs several different
texts beside an entity, so copies of one text reveal nothing by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.sources.scratch import materialize

#: Kinds in listed order, and their patterns. The look-behinds and fixed counts give the
#: matches of the plain patterns in linear time: an address starts where its run of
#: characters starts, a number is a maximal run of digits.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}

NEAR = 60  # characters on either side of an entity in which a term counts as near
LEAST_TEXTS = 3  # different texts that hold term and entity together
DISCLOSED = 0.9  # PMI(e; t) / IC(e) from which a term is generalised
REVEALED = 0.999  # from which it is removed

_FOUND = "array<struct<start:int,end:int,value:string>>"
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
_LUHN = """
    aggregate(
      transform(reverse(split(translate(s.value, ' -', ''), '')), (d, i) -> IF(i % 2 = 0, int(d), IF(int(d) > 4, 2 * int(d) - 9, 2 * int(d)))),
      0, (a, d) -> a + d) % 10 = 0"""
_VALID = {
    "email": "true",
    "ip": "forall(split(s.value, '[.]'), p -> length(ltrim('0', p)) <= 3 AND int(concat('0', right(ltrim('0', p), 3))) <= 255)",
    "card": _LUHN,
    "phone": "length(regexp_replace(s.value, '[^0-9]', '')) BETWEEN 9 AND 15",
}


def _found(gaps: str, values: str) -> Column:
    """Start, end (code points) and text of matches, from what is between them and them."""
    return F.expr(f"""
        aggregate(
          zip_with(slice({gaps}, 1, size({values})), {values}, (g, v) -> named_struct('gap', length(g), 'v', v)),
          named_struct('at', 0, 'out', cast(array() AS {_FOUND})),
          (s, x) -> named_struct('at', s.at + x.gap + length(x.v), 'out',
            concat(s.out, array(named_struct('start', s.at + x.gap, 'end', s.at + x.gap + length(x.v), 'value', x.v)))),
          s -> s.out)""")


def with_base_spans(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """Adds the spans of the four base kinds, by start and then kind."""
    rows = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    for kind, pattern in PATTERNS.items():
        holds = F.regexp_like("_t", F.lit(NEEDS[kind]))
        rows = rows.withColumn(f"_v_{kind}", F.when(holds, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for kind, pattern in PATTERNS.items():
        rows = rows.withColumn(f"_g_{kind}", F.when(F.size(f"_v_{kind}") > 0, F.split("_t", pattern, -1)).otherwise(F.array().cast("array<string>")))
    for kind in PATTERNS:
        rows = rows.withColumn(f"_s_{kind}", _found(f"_g_{kind}", f"_v_{kind}"))
    spans = [
        F.expr(f"transform(filter(_s_{kind}, s -> {_VALID[kind]}), s -> named_struct('start', s.start, 'rank', {rank}, 'end', s.end, 'kind', '{kind}', 'value', s.value))")
        for rank, kind in enumerate(PATTERNS)
    ]
    rows = rows.withColumn(out, F.array_sort(F.concat(*spans)))
    return rows.drop("_t", *(f"_{c}_{kind}" for kind in PATTERNS for c in "vgs"))


def disclosing_terms(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, disclosure) of terms at or above DISCLOSED.

    `spans` has h (text hash), text and base; `texts` h and text of all rows.
    """
    kinds = spans.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.first("text").alias("text"), F.first("base").alias("base"))
    near = kinds.select("h", "rows", "text", F.explode("base").alias("s")).select(
        "h", "rows",
        F.concat("s.kind", F.lit(":"), F.when(F.col("s.kind").isin("card", "phone"), F.regexp_replace("s.value", "[^0-9]", "")).otherwise(F.lower("s.value"))).alias("entity"),
        F.expr(f"substring(text, greatest(s.start - {NEAR}, 0) + 1, least(s.start, {NEAR}))").alias("before"),
        F.expr(f"substring(text, s.end + 1, {NEAR})").alias("after"),
    )
    # Words that the window cuts are left out: a word needs a non-letter on its outer side.
    words = F.concat(F.regexp_extract_all("before", F.lit(r"(?<=[^\p{L}])\p{L}{3,}(?=[^\p{L}])"), F.lit(0)), F.regexp_extract_all("after", F.lit(r"(?<=[^\p{L}])\p{L}{3,}(?=[^\p{L}])"), F.lit(0)))
    pairs = near.select("h", "rows", "entity", F.explode(F.array_distinct(F.transform(words, lambda w: F.lower(w)))).alias("term")).distinct()
    joint = materialize(
        pairs.groupBy("entity", "term").agg(F.sum("rows").alias("both"), F.count(F.lit(1)).alias("texts_both")).filter(F.col("texts_both") >= LEAST_TEXTS)
    )
    entities = near.select("h", "rows", "entity").distinct().groupBy("entity").agg(F.sum("rows").alias("texts"))
    # Counted per task before the shuffle and only then met with the terms in question.
    held = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("term"))
    spread = held.groupBy("term").agg(F.count(F.lit(1)).alias("spread")).join(joint.select("term").distinct(), "term")
    total = F.lit(float(max(texts.count(), 2)))
    known = -F.log2(F.least(F.col("texts") / total, F.lit(0.999999)))
    gain = F.log2((F.col("both") / F.col("spread")) / (F.col("texts") / total))
    return (
        joint.join(entities, "entity").join(spread, "term").groupBy("term").agg(F.max(gain / known).alias("disclosure"))
        .filter(F.col("disclosure") >= DISCLOSED)
    )


def personal_spans(docs: DataFrame) -> DataFrame:
    """Of every row of docs (doc_id, text, others): doc_id, text, spans (base spans and terms),
    and `row`, all its columns as a struct.

    A span has start and end (code points, end exclusive), kind, rank (order of kinds) and
    value. NULL or empty texts have none. Terms are searched in every text, whether or not it
    holds the entity. Repeated rows get the same spans; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct("*").alias("row"), F.xxhash64(text).alias("_h"))
    texts = rows.select(F.col("_h").alias("h"), text.alias("text"))
    marked = materialize(with_base_spans(texts).filter(F.size("base") > 0).select("h", "text", "base"))
    terms = materialize(disclosing_terms(marked, texts))
    held = texts.select("h", "text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("term"))
    places = (
        held.join(terms, "term").dropDuplicates(["h", "term"])
        .withColumn("_w", F.concat(F.lit(r"(?iu)(?<!\p{L})"), "term", F.lit(r"(?!\p{L})")))
        .withColumn("_v", F.regexp_extract_all("text", F.col("_w"), F.lit(0))).withColumn("_g", F.expr("split(text, _w, -1)"))
        .withColumn("_s", _found("_g", "_v"))
        .select("h", F.explode("_s").alias("s"), "disclosure")
        .groupBy(F.col("h").alias("_h")).agg(F.array_sort(F.collect_list(F.struct(
            F.col("s.start").alias("start"), F.lit(len(PATTERNS)).alias("rank"), F.col("s.end").alias("end"), F.lit("term").alias("kind"),
            F.when(F.col("disclosure") >= REVEALED, F.lit("")).otherwise(F.lit("[TERM]")).alias("value")))).alias("_terms"))
    )
    places = materialize(places)
    base = with_base_spans(rows, out="_base")
    return (
        base.join(places, "_h", "left")
        .withColumn("spans", F.array_sort(F.concat("_base", F.coalesce("_terms", F.array().cast(f"array<{SPAN}>")))))
        .drop("_h", "_base", "_terms")
    )


def sanitise(text: Column, spans: Column) -> Column:
    """The text with base spans replaced by their kind and terms generalised or removed;
    of overlapping spans the first decides.
    """
    mask = lambda s: F.when(s["kind"] == "term", s["value"]).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), mask(s)).alias("out")),
    ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def digest(spans: Column) -> Column:
    """`kind:start:end` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
