"""License scan: an Aho-Corasick automaton finds identifier tags and notice phrases, a
shunting-yard parser evaluates the licence expressions behind the tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrases whose places are counted, and their labels. Fixed values.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Further notices and their labels.
NOTICES = {
    "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "mozilla public license": "mpl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "isc license": "isc",
    "boost software license": "bsl", "eclipse public license": "epl", "cc by": "cc-by", "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0": "cc0", "public domain dedication": "cc0", "creative commons attribution": "cc-by",
    "all rights reserved": "proprietary", "released into the public domain": "public-domain",
    "permission is hereby granted free of charge": "mit", "licensed under the apache": "apache",
}
#: Tags with a licence expression behind them.
TAGS = ("spdx license identifier", "license expression")

#: How far a label restricts reuse, 0 to 1; a label not named here counts half.
RESTRICTS = {
    "public-domain": 0.0, "cc0": 0.0, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "bsl": 0.1, "apache": 0.2, "cc-by": 0.2, "mpl": 0.4,
    "epl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.7, "cc-by-nd": 0.8, "cc-by-nc": 0.8, "agpl": 0.9, "cc-by-nc-sa": 0.9,
    "cc-by-nc-nd": 0.9, "proprietary": 1.0,
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TAG = re.compile(r"(?:spdx-license-identifier|license-expression)\s*[:=]\s*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}
_FAMILY = re.compile(r"(cc-by(?:-nc)?(?:-nd|-sa)?|cc0|agpl|lgpl|gpl|mit|apache|bsd|mpl|isc|bsl|epl|unlicense)(?![a-z])")


def family(identifier: str) -> str:
    """The label of a licence identifier: its family, or itself."""
    name = identifier.lower()
    m = _FAMILY.match(name)
    return {"unlicense": "public-domain"}.get(m[1], m[1]) if m else name


def parse(expression: str) -> list[str] | None:
    """Identifiers and operators of an expression in postfix order; None if malformed.

    WITH binds closer than AND, AND closer than OR. Text behind a complete expression
    (a comment's end) is left out.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # whether an identifier or "(" comes next
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if operand:
            if token == "(":
                waiting.append(token)
            elif low in _BINDS or token == ")":
                return None
            else:
                out.append(token)
                operand = False
        elif low in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = True
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                break
            waiting.pop()
        else:
            break
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels in an expression and how far it restricts: OR leaves the choice (smaller),
    AND asks for both (larger), WITH grants an exception (half).
    """
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in _BINDS:
            label = family(token)
            stack.append(({label}, RESTRICTS.get(label, 0.5)))
            continue
        (b, y), (a, x) = stack.pop(), stack.pop()
        stack.append((a, x / 2) if token == "with" else (a | b, min(x, y) if token == "or" else max(x, y)))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS))):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, len(phrase) + 2, label))
    found.make_automaton()
    return found


def scan(text: str, find: ahocorasick.Automaton) -> dict:
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
    line = f" {' '.join(words)} "
    places, base, labels, score = [], set(), set(), 0.0
    at = word = 0
    tagged = False
    for end, (kind, size, label) in find.iter(line):
        if kind == "tag":
            tagged = True
            continue
        labels.add(label)
        if kind == "base":
            start = end - size + 1
            word += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
            at = start
            places.append(word)
            base.add(label)
    score = max((RESTRICTS.get(x, 0.5) for x in labels), default=0.0)
    for expression in _TAG.findall(text) if tagged else ():
        postfix = parse(expression)
        if postfix:
            more, restricts = evaluate(postfix)
            labels |= more
            score = max(score, restricts)
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "places": places,
    }


_OUT = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, places array<bigint>"


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): number of words, places of the base phrases (their
    first words), the labels found, and score: how far the licences restrict reuse (0: free
    or none).

    NULL counts as empty; empty texts have no words, no labels and score 0. Repeated rows
    stay; an empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton()
        for batch in batches:
            rows = [scan(t.as_py() or "", find) for t in batch.column(1)]
            columns = [batch.column(0)]
            names = ["doc_id"]
            for name, type_ in (part.rsplit(" ", 1) for part in _OUT.split(", ")):
                arrow = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}[type_]
                columns.append(pa.array([r[name] for r in rows], arrow))
                names.append(name)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {_OUT}")
