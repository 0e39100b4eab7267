"""Toxicity by weak supervision.

Voters are a word lexicon and patterns (whole words, word beginnings and endings) that
are much more frequent in texts labelled toxic, counted over all labelled training rows. A
vote is cast where a voter occurs in a text. A generative label model is fitted on the
votes of all documents by expectation maximisation: for each voter how often it fires on
toxic and on other texts, and for each pair of voters their correlation within the
classes, by which the say of voters that repeat each other is cut. Its posterior labels
train a logistic model on the votes, and that model scores texts.

Labels are read for training rows only (crc32 of doc_id mod 5 is not 0). They choose the
voters, set the scale and the base of the votes, and in the label model they are one more
vote, of accuracy SURE, on the rows that have one: evidence against or for, which other
votes can outweigh. The classifier is trained on the posteriors alone. Only the rows given
to the fit of the scale and to that of the classifier are bounded, by FIT_ROWS.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from evalweave.llm.frugal import frugal, small_batches
from evalweave.sources.scratch import materialize

FIT_ROWS = 20_000  # rows of votes for the scale of the posteriors and for the classifier, labelled and other
ROUNDS = 3  # of expectation maximisation
EVIDENCE = 14.0  # nats by which a pattern's labels must differ from the base rate (chance: about 1 in 10^6)
ODDS = 20.0  # times by which a pattern is more frequent in toxic than in other texts
LABELS = 1 << 20  # labelled rows up to which they are broadcast to the texts
SIEVE = 1 << 22  # places of the table that tells tasks which patterns are worth counting
SURE = 0.99  # accuracy of a label as a vote in the label model
HELD = 100_000  # patterns or pairs of voters a task counts before it hands the counts on

#: Insults in the four languages of the texts. Fixed values.
LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb dumbass scum trash garbage loser losers pathetic worthless disgusting clown freak pervert bitch"
    " bastard whore slut retard retarded imbecile jerk asshole fuck fucking shit vermin filth filthy hate kill ugly"
    " idioten dummkopf abschaum versager arschloch hurensohn schlampe missgeburt depp trottel scheisse wichser"
    " imbécile connard salaud ordure racaille débile salope merde crétin abruti"
    " idiota imbécil estúpido basura escoria inútil perdedor payaso mierda puta cabrón asqueroso patético".split()
)
_WORD = re.compile(r"[^\W\d_]+")
#: Cuts of a word that can be a pattern: its first or last so many characters.
CUTS = (("^", 4), ("^", 5), ("^", 6), ("$", 4), ("$", 5))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _cut(word: str, side: str, n: int) -> str:
    return word[:n] if side == "^" else word[-n:]


def patterns_of(words: set[str]) -> set[str]:
    """All patterns a text holds: `=word`, `^4begi`, `$4ding`."""
    out = {"=" + w for w in words}
    for side, n in CUTS:
        out |= {f"{side}{n}{_cut(w, side, n)}" for w in words if len(w) > n}
    return out


class Voters:
    """A fixed list of patterns, with the lookup of those that a text holds."""

    def __init__(self, names: list[str]):
        self.names = names
        self.words = {v[1:]: i for i, v in enumerate(names) if v[0] == "="}
        self.cuts = [(side, n, {v[2:]: i for i, v in enumerate(names) if v.startswith(f"{side}{n}")}) for side, n in CUTS]

    def fired(self, text: str) -> list[int]:
        words = words_of(text)
        out = {self.words[w] for w in words & self.words.keys()}
        for side, n, known in self.cuts:
            if known:
                held = {w[:n] for w in words if len(w) > n} if side == "^" else {w[-n:] for w in words if len(w) > n}
                out |= {known[c] for c in held & known.keys()}
        return sorted(out)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _training(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the training rows that have a label; one row an id."""
    return (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )


def _share(rows: DataFrame, most: int) -> DataFrame:
    """About `most` rows at most, picked by a hash of doc_id."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(1_000_000)) < 1_000_000 * most // n)


def _pattern_counts(sieve=None):
    """Per task: how many texts hold each pattern, of those whose place in the sieve is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        open_ = None if sieve is None else sieve.value

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["name", "n"])

        for batch in batches:
            for text in batch.column(0):
                names = patterns_of(words_of(text.as_py() or ""))
                seen.update(names if open_ is None else [v for v in names if open_[crc32(v.encode("utf-8", "surrogatepass")) % SIEVE]])
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return run


def mine_voters(docs: DataFrame, training: DataFrame) -> Voters:
    """The lexicon and all patterns that tell: by EVIDENCE and by ODDS, over all labelled training rows.

    Toxic texts come first; a pattern in too few of them cannot reach the evidence. Other texts
    are then counted for the patterns left, which tasks know by a table of fixed size.
    """
    size = {r["toxic"]: r["c"] for r in training.groupBy("toxic").agg(F.count(F.lit(1)).alias("c")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    names = sorted("=" + w for w in LEXICON)
    if not (bad and good):
        return Voters(names)
    base = bad / (bad + good)
    # Up to LABELS rows of 12 bytes go to all tasks; beyond that the texts are shuffled by doc_id.
    marks = F.broadcast(training) if bad + good <= LABELS else training
    texts = docs.join(marks, "doc_id").select("text", "toxic")

    def counts(label: int, sieve=None) -> DataFrame:
        rows = texts.filter(F.col("toxic") == label).select("text").mapInArrow(frugal(_pattern_counts(sieve)), "name string, n bigint")
        return rows.groupBy("name").agg(F.sum("n").alias("n"))

    least = math.ceil(EVIDENCE / -math.log(base))
    toxic = materialize(counts(1).filter(F.col("n") >= least).withColumnRenamed("n", "toxic"))
    places = toxic.select((F.crc32(F.col("name").cast("binary")) % SIEVE).cast("int").alias("p")).distinct().toPandas()["p"]  # SIEVE at most
    sieve = np.zeros(SIEVE, dtype=bool)
    sieve[places.to_numpy()] = True
    clean = counts(0, docs.sparkSession.sparkContext.broadcast(sieve)).withColumnRenamed("n", "clean")
    both = toxic.join(clean, "name", "left").withColumn("clean", F.coalesce("clean", F.lit(0)))
    p = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    differs = F.col("toxic") * F.log(p / base) + F.when(p < 1, F.col("clean") * F.log((1 - p) / (1 - base))).otherwise(0.0)
    odds = F.col("toxic") * good >= ODDS * F.col("clean") * bad
    found = both.filter(odds & (p > base) & (differs >= EVIDENCE)).orderBy(F.desc(differs), "name").select("name").toPandas()["name"]
    known = set(names)
    return Voters(names + [v for v in found if v not in known])


def _votes(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fired = [voters.fired(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fired, pa.list_(pa.int32()))], names=["doc_id", "fired"])

    return run


class LabelModel:
    """P(vote | toxic), P(vote | other), the prior, and the say of each voter."""

    def __init__(self, on: np.ndarray, off: np.ndarray, prior: float, say: np.ndarray):
        self.gain = say * np.log(on / off)
        silent = float((say * np.log((1 - on) / (1 - off))).sum())
        self.base = math.log(prior / (1 - prior)) + max(silent, -3.0)

    def calibrate(self, fired: np.ndarray, row: np.ndarray, label: np.ndarray) -> None:
        """Scale gains and prior so that posteriors fit the labels of labelled rows."""
        if not ((label == 0).any() and (label == 1).any()):
            return
        known = np.flatnonzero(label >= 0)
        x = np.bincount(row, weights=self.gain[fired], minlength=len(label))[known]
        w, bias = fit_classifier(np.zeros(len(known), np.int64), np.arange(len(known)), label[known], 1, x)
        self.gain, self.base = self.gain * max(float(w[0]), 0.1), bias

    def posterior(self, fired: np.ndarray, row: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(toxic) of rows given as a flat list of votes; a label (0 or 1) is one more vote, of accuracy SURE."""
        x = self.base + np.bincount(row, weights=self.gain[fired], minlength=len(label))
        x += np.where(label >= 0, np.where(label == 1, 1, -1), 0) * math.log(SURE / (1 - SURE))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pairs(fired: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, i, j) of the pairs of votes of each row, by the distance of the two votes in it."""
    step = 1
    while step < len(fired) and len(at := np.flatnonzero(row[step:] == row[:-step])):
        yield row[at], fired[at], fired[at + step]
        step += 1


def _moments(model: LabelModel, pairs: bool, size: int):
    """Per task: sums of P(toxic) and P(other) over all rows, for each voter and, if asked
    for, each pair of voters. Rows (i, j, on, off); i = j for a voter, -1 for all rows.
    """

    def rows_of(i: np.ndarray, j: np.ndarray, on: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(v).cast(t) for v, t in zip((i, j, on, off), kinds, strict=True)], names=["i", "j", "on", "off"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, rows = np.zeros((2, size)), np.zeros(2)
        key, two = np.zeros(0, np.int64), np.zeros((2, 0))  # sums of the pairs seen so far, sorted by pair
        for batch in batches:
            lists = batch.column(0)
            fired, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            label = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            p = model.posterior(fired, row, label)
            weights = np.stack((p, 1 - p))
            rows += weights.sum(axis=1)
            for k in range(2):
                one[k] += np.bincount(fired, weights=weights[k][row], minlength=size)
            for r, i, j in _pairs(fired, row) if pairs else ():
                key, place = np.unique(np.concatenate((key, i.astype(np.int64) * size + j)), return_inverse=True)
                two = np.stack([np.bincount(place, weights=np.concatenate((two[k], weights[k][r])), minlength=len(key)) for k in range(2)])
                if len(key) > HELD:
                    yield rows_of(key // size, key % size, *two)
                    key, two = key[:0], two[:, :0]
        yield rows_of(np.array([-1]), np.array([-1]), rows[:1], rows[1:])
        yield rows_of(np.arange(size), np.arange(size), *one)
        if len(key):
            yield rows_of(key // size, key % size, *two)

    return run


def _repeated(pairs: DataFrame, on: np.ndarray, toxic: float, size: int) -> np.ndarray:
    """For each voter the sum of its correlations (above 0.1) with other voters on toxic texts.

    The pairs stay in Spark; one number a voter goes in with the plan's table and one comes back.
    """
    session = pairs.sparkSession
    rate = F.broadcast(session.createDataFrame(list(enumerate(on.tolist())), "v int, p double"))  # a row a voter
    both = pairs.join(rate.select(F.col("v").alias("i"), F.col("p").alias("pi")), "i").join(rate.select(F.col("v").alias("j"), F.col("p").alias("pj")), "j")
    spread = F.sqrt(F.col("pi") * (1 - F.col("pi")) * F.col("pj") * (1 - F.col("pj")))
    rho = F.least((F.col("on") / (toxic + 1) - F.col("pi") * F.col("pj")) / spread, F.lit(1.0))
    strong = both.filter(F.col("on") >= 2).select("i", "j", rho.alias("rho")).filter("rho > 0.1")
    sums = strong.select(F.explode(F.array("i", "j")).alias("v"), "rho").groupBy("v").agg(F.sum("rho").alias("s")).toPandas()
    return np.bincount(sums["v"], weights=sums["s"], minlength=size)


def fit_label_model(votes: DataFrame, size: int) -> LabelModel:
    """Expectation maximisation over the votes of all documents (fired, toxic or NULL).

    Rows count by the posterior of the step before, in which a label is one more vote.
    """
    on, off, prior, say = np.full(size, 0.3), np.full(size, 0.01), 0.1, np.ones(size)
    narrow = votes.select("fired", "toxic")
    for k in range(ROUNDS):
        pairs = k == 0  # correlations are read once, under the first posterior
        parts = narrow.mapInArrow(frugal(_moments(LabelModel(on, off, prior, say), pairs, size)), "i int, j int, on double, off double")
        sums = parts.groupBy("i", "j").agg(F.sum("on").alias("on"), F.sum("off").alias("off"))
        sums = materialize(sums) if pairs else sums
        own = sums.filter("i = j").toPandas().sort_values("i")  # a row a voter, and one for all rows
        if own.empty or own["i"].iloc[0] != -1:
            break
        a, b = float(own["on"].iloc[0]), float(own["off"].iloc[0])
        on, off = (own["on"].to_numpy()[1:] + 0.3) / (a + 1), (own["off"].to_numpy()[1:] + 0.02) / (b + 2)
        on, off = np.clip(on, 1e-6, 0.999), np.clip(off, 1e-7, 0.999)
        prior = min(max((a + 1) / (a + b + 2), 0.01), 0.5)
        if pairs:
            say = 1 / (1 + _repeated(sums.filter("i < j"), on, a, size))
    return LabelModel(on, off, prior, say)


def fit_classifier(
    fired: np.ndarray, row: np.ndarray, target: np.ndarray, size: int, value: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Logistic regression of (posterior) labels on votes, with a small ridge, by gradient
    steps. `value` weighs the votes (1 if not given).
    """
    value = np.ones(len(fired)) if value is None else value
    w, bias = np.zeros(size), 0.0
    m, v, n = np.zeros(size + 1), np.zeros(size + 1), max(len(target), 1)
    for step in range(1, 501):
        x = bias + np.bincount(row, weights=w[fired] * value, minlength=len(target))
        d = (1 / (1 + np.exp(-np.clip(x, -30, 30))) - target) / n
        g = np.append(np.bincount(fired, weights=d[row] * value, minlength=size) + 1e-6 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame):
    """A scorer of text columns, from documents (doc_id, text) and labels (doc_id, toxic).

    NULL texts count as empty; rows of one label id count once (the larger label); without
    labelled rows the lexicon alone votes. Other columns are never read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    training = materialize(_training(labels))
    voters = mine_voters(docs, training)
    size = len(voters.names)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cast = docs.mapInArrow(frugal(_votes(voters)), f"doc_id {kind}, fired array<int>")
    votes = materialize(cast.join(training, "doc_id", "left"))
    model = fit_label_model(votes, size)
    # Rows for the classifier: labelled ones and others, both bounded by FIT_ROWS.
    some = _share(votes.filter("toxic IS NOT NULL"), FIT_ROWS).union(_share(votes.filter("toxic IS NULL"), FIT_ROWS)).select("fired", "toxic").toPandas()
    lists = [np.asarray(f, dtype=np.int64) for f in some["fired"]]
    fired = np.concatenate([np.zeros(0, dtype=np.int64), *lists])
    row = np.repeat(np.arange(len(lists)), [len(f) for f in lists]).astype(np.int64)
    label = some["toxic"].fillna(-1).to_numpy(dtype=np.int64)
    model.calibrate(fired, row, label)
    target = model.posterior(fired, row, label)
    weights, bias = fit_classifier(fired, row, target, size) if len(target) else (model.gain, model.base)

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([bias + sum(weights[i] for i in voters.fired(t.as_py() or "")) for t in texts], dtype=float)
        return pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every row.

    Empty and NULL texts get the score of a text without votes. Repeated rows stay; an
    empty table gives an empty result; other columns are ignored.
    """
    score = fit(docs, labels)
    rows = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
