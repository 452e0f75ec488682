"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become labels: i (insult), t (threat), y (target), n (negation), r (reported speech), o (other). One transducer
reads a clause's labels from its end and writes a (aimed threat) for a threat up to 4 words before a target. More of them
rewrite the labels from the start, one after the other, composed into one machine:

    target    an insult or threat up to 4 words after a target counts 1.5 times
    threat    a threat that isn't aimed counts only if a target stands up to 4 words before it
    negation  an insult or threat up to 3 words after a negation counts 0.2 times
    reported  after a verb of saying followed by a colon, quote or `that`, to the clause's end, it counts 0.4 times

An aimed threat counts 1.5 times as one after its target does. A clause's score is the sum, over its insults and threats, of the word's weight times the machine's factor; a
document's score is a logistic of log(1 + the sum over its clauses). A learned word that is also in a fixed list keeps
its part there and is read as an insult besides; the larger of both readings counts.

The insult lexicon is learned from labels: words of any length, and beginnings of 4 to 7 letters, whose
log-odds between toxic and other documents reach LEAST_ODDS and that stand in enough different toxic texts (how many
depends on how many words could reach it by chance). Texts are told apart by the least hash of their runs of 3 words,
which copies share and most near copies too, so these don't count as evidence. The sample is
SAMPLE labelled documents at most, about, with their whole texts. The logistic is fitted on sums that each text gets from entries
learned without its own part of the sample (PARTS parts; copies, and most near copies, share one).

Null and empty texts have no clause and get the score of a text without matches. Without toxic labels nothing is learned, and
the fixed word lists remain. Repeated rows each return a row; an empty table gives no rows; extra
columns are ignored by predict() and kept by clean().
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_text_batches, saved, table, written
from .labelled import chance, drawn, fold, logistic

SAMPLE = 6000
CUT = 0.5
#: Parts of the sample; a part's totals, which calibrate scores, come from what the others teach.
PARTS = 5
LEAST_ODDS, LEAST_SUPPORT = 3.0, 4
BEGINNINGS = (4, 5, 6, 7)
#: The weight of a word of the fixed lists, and what multiplies weights: aimed at a target, negated, reported.
SEED_WEIGHT, AIMED, NEGATED, TOLD = 5.0, 1.5, 0.2, 0.4
#: Words of four languages.
INSULTS = "idiot idiots moron morons imbecile imbeciles scum bastard bastards idiota idiotas imbécil imbéciles imbécile dummkopf trottel idioten connard connards salaud salauds crétin cretino cretinos".split()
THREATS = "kill hurt destroy punish attack murder beat strangle töten umbringen vernichten verprügeln erwürgen tuer frapper détruire étrangler matar golpear destruir estrangular".split()
TARGETS = "you your yours yourself yourselves they them their those dich dir ihr ihnen euch euer eure toi vous votre eux leur leurs vosotros ustedes ellos vuestro".split()
NEGATIONS = "not no never nobody nothing neither isn aren wasn weren don doesn didn won cannot nicht kein keine keinen nie niemals niemand pas jamais aucun aucune ne nunca jamás tampoco ningún ninguna".split()
REPORTS = "said says say saying called calls claimed claims wrote writes reported quoted quotes sagt sagte schreibt schrieb behauptet behauptete zitierte dit disait écrit écrivait déclaré dijo dice escribió llamó afirmó".split()
#: Words that open what is reported, as marks do.
OPENERS = "that dass que".split()

LETTERS = re.compile(r"[^\W\d_]+")
WORD = re.compile(r"[^\W\d_]+|[:\"“”«»]")
#: Labels that score when the machine has written them.
COUNTED = "ita"
CLAUSE_END = re.compile(r"[.;!?\n]")
OUT = "doc_id long, held_out boolean, score double, predicted int, clauses int"


class Transducer:
    """A deterministic transducer: step(state, label) -> (state, label, factor). Factors multiply."""

    start: tuple | int = 0

    def step(self, state, label: str):
        raise NotImplementedError

    def __rshift__(self, after: Transducer) -> Transducer:
        return Composed(self, after)


class Composed(Transducer):
    """The second reads what the first writes; arcs are made when first used and kept."""

    def __init__(self, a: Transducer, b: Transducer):
        self.a, self.b, self.start, self.arcs = a, b, (a.start, b.start), {}

    def step(self, state, label):
        arc = self.arcs.get((state, label))
        if arc is None:
            s, middle, x = self.a.step(state[0], label)
            u, out, z = self.b.step(state[1], middle)
            arc = self.arcs[state, label] = ((s, u), out, x * z)
        return arc


class Near(Transducer):
    """Labels of `on` up to `reach` words after one of `opens` get the factor, and with `only` others of `on` become o."""

    def __init__(self, opens: str, on: str, reach: int, factor: float, only: str = ""):
        self.opens, self.on, self.reach, self.factor, self.only = opens, on, reach, factor, only

    def step(self, state, label):
        if label == self.opens:
            return self.reach, label, 1.0
        left = max(0, state - 1)
        if label in self.only and not state:
            return left, "o", 1.0
        return (left, label, self.factor) if state and label in self.on else (left, label, 1.0)


class Weighted(Transducer):
    """Every label of `on` gets the factor."""

    def __init__(self, on: str, factor: float):
        self.on, self.factor = on, factor

    def step(self, state, label):
        return state, label, self.factor if label in self.on else 1.0


class Reported(Transducer):
    """From a verb of saying followed by a mark or `that` to the end of the clause."""

    def step(self, state, label):
        if label == "r":
            return 1 if state < 2 else 2, label, 1.0
        if label == "q":
            return 2 if state else 0, label, 1.0
        return (2, label, TOLD) if state == 2 and label in COUNTED else (state if state == 2 else 0, label, 1.0)


class Ahead(Transducer):
    """Reads labels from the end: a threat up to `reach` words before a target becomes an aimed one."""

    def __init__(self, reach: int):
        self.reach = reach

    def step(self, state, label):
        if label == "y":
            return self.reach, label, 1.0
        return max(0, state - 1), "a" if state and label == "t" else label, 1.0


def grammar() -> Transducer:
    return Near("y", "it", 4, AIMED, only="t") >> Weighted("a", AIMED) >> Near("n", COUNTED, 3, NEGATED) >> Reported()


class Scanner:
    """Finds the clauses with insults or threats by one automaton over all entries, and scores them."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], machine: Transducer | None = None):
        import ahocorasick

        self.words = {**words, **{w: max(SEED_WEIGHT, words.get(w, 0.0)) for w in INSULTS}}
        self.beginnings = beginnings
        self.lengths = sorted({len(b) for b in beginnings})
        self.machine, self.ahead = machine or grammar(), Ahead(4)
        self.fixed = {w: k for k, names in (("t", THREATS), ("y", TARGETS), ("n", NEGATIONS), ("r", REPORTS)) for w in names} | {c: "q" for c in (*OPENERS, *":\"“”«»")}
        self.entries = ahocorasick.Automaton()
        for e in {*self.words, *THREATS, *beginnings}:
            self.entries.add_word(e, len(e))
        self.entries.make_automaton()

    def weight(self, word: str) -> float:
        w = self.words.get(word, 0.0)
        for n in self.lengths:
            if len(word) >= n:
                w = max(w, self.beginnings.get(word[:n], 0.0))
        return w

    def clause(self, text: str) -> float:
        found = WORD.findall(text)
        weights = [self.weight(word) for word in found]
        labels = [self.fixed.get(word) or ("i" if w else "o") for word, w in zip(found, weights)]
        if "t" in labels:
            state = self.ahead.start
            for k in range(len(labels) - 1, -1, -1):
                state, labels[k], _ = self.ahead.step(state, labels[k])
        state, score = self.machine.start, 0.0
        for label, w in zip(labels, weights):
            as_insult = self.machine.step(state, "i") if w and label != "i" else None
            state, out, factor = self.machine.step(state, label)
            own = (w if out == "i" else max(w, SEED_WEIGHT)) * factor if out in COUNTED else 0.0
            score += max(own, w * as_insult[2]) if as_insult else own
        return score

    def document(self, text: str | None) -> tuple[float, int]:
        """The sum of the scores of its clauses, and how many matched."""
        if not text:
            return 0.0, 0
        low, end, total, n = text.lower(), 0, 0.0, 0
        for last, size in self.entries.iter(low):
            at = last - size + 1
            if at < end or (at and low[at - 1].isalpha()):
                continue
            start = max((low.rfind(c, end, at) for c in ".;!?\n"), default=-1) + 1
            start = max(start, end)
            stop = CLAUSE_END.search(low, last)
            end = stop.start() if stop else len(low)
            score = self.clause(low[start:end])
            total, n = total + score, n + (score > 0)
        return total, n


def _own(words: list[str]) -> int:
    """The least hash of a text's runs of three words."""
    import xxhash

    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))) - (1 << 63)


def _parted(sample: DataFrame) -> DataFrame:
    """sample (doc_id, text, y) with `part`, which the text's own hash decides. Bounded by SAMPLE and read several times, so it's written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [LETTERS.findall((t or "").lower()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_own(w) % PARTS if w else 0 for w in words], pa.int32())], names=["doc_id", "text", "y", "part"])

    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("y").cast("int").alias("y"))
    return written(in_text_batches(rows).mapInArrow(run, "doc_id long, text string, y int, part int"))


def _keys(rows: DataFrame) -> DataFrame:
    """doc_id, text, part, kind and e of rows (doc_id, text, y, part): each word (w) and beginning (b) of a text once, and the text's own hash.

    A task holds one text's distinct words at a time, however long the text is.
    """
    names = ["doc_id", "text", "part", "kind", "e"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = LETTERS.findall((text or "").lower())
                if words:
                    found = sorted({("w", w) for w in words} | {("b", w[:k]) for w in words for k in BEGINNINGS if len(w) >= k})
                    kinds, keys = zip(*found)
                    same = [pa.array([v] * len(found), t) for v, t in ((doc_id, pa.int64()), (_own(words), pa.int64()), (part, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(kinds), pa.array(keys)], names=names)

    return in_text_batches(rows.select("doc_id", "text", "part")).mapInArrow(run, "doc_id long, text long, part int, kind string, e string")


def _counts(parted: DataFrame) -> DataFrame:
    """kind, e, part, pos (toxic documents with it), texts (different ones) and neg (others with it), for all that LEAST_SUPPORT toxic documents have.

    Copies share a part, so what parts count adds up. As many entries at most as the bounded sample's toxic texts have words.
    """
    pos = _keys(parted.where("y = 1")).groupBy("kind", "e", "part").agg(F.countDistinct("doc_id").alias("pos"), F.countDistinct("text").alias("texts"))
    pos = saved(pos.withColumn("all", F.sum("pos").over(Window.partitionBy("kind", "e"))).where(F.col("all") >= LEAST_SUPPORT).drop("all"))
    both = pos.groupBy("kind", "e").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= LEAST_SUPPORT).select("kind", "e")
    neg = _keys(parted.where("y = 0")).join(both, ["kind", "e"]).groupBy("kind", "e", "part").agg(F.countDistinct("doc_id").alias("neg"))
    return saved(pos.withColumn("neg", F.lit(0).cast("long")).unionByName(neg.withColumns({"pos": F.lit(0).cast("long"), "texts": F.lit(0).cast("long")})))


def _entries(counts: DataFrame, pos: int, n: int) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and of beginnings from the counts of n documents, pos of them toxic. What reaches LEAST_ODDS comes to the driver."""
    if not pos or pos == n:
        return {}, {}
    own = counts.groupBy("kind", "e").agg(*[F.sum(c).alias(c) for c in ("pos", "texts", "neg")]).where(F.col("pos") >= LEAST_SUPPORT)
    tried = own.count()
    support = max(LEAST_SUPPORT, math.ceil((math.log(max(1, tried)) + 3) / math.log(n / pos)))
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (n - pos + 1))
    best = own.where(F.col("texts") >= support).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    best = best.collect()
    words = {r.e: float(r.odds) for r in best if r.kind == "w"}
    # A beginning stands for its words only where none of them, and no longer beginning, has most of its documents.
    found = {r.e: r for r in best if r.kind == "b"}
    narrow = lambda b: any(len(r.e) + (r.kind == "w") > len(b) and r.e.startswith(b) and r.pos >= 0.9 * found[b].pos for r in best)
    beginnings: dict[str, float] = {}
    for b in sorted(found, key=len):
        if not narrow(b) and not any(b.startswith(x) for x in beginnings):
            beginnings[b] = float(found[b].odds)
    return words, beginnings


def entries_of(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and of beginnings. Counting is a Spark aggregation."""
    parted = _parted(sample)
    pos, n = parted.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    return _entries(_counts(parted), pos, n)


class Model:
    def __init__(self, words: dict[str, float], beginnings: dict[str, float], ab: tuple[float, float]):
        self.words, self.beginnings, self.ab = words, beginnings, ab


def _scanned(rows: DataFrame, words: dict, beginnings: dict) -> DataFrame:
    """y and the total of each row (doc_id, text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(words, beginnings)
        for b in batches:
            total = [s.document(t)[0] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(total, pa.float64())], names=["y", "total"])

    return in_text_batches(rows).mapInArrow(run, "y int, total double")


def train(sample: DataFrame) -> Model:
    """sample: doc_id, text, y (1: toxic). All of it teaches the entries; the logistic is fitted on what the other parts' entries make of each text."""
    parted = _parted(sample)
    size = {r.part: (r.pos, r.n) for r in parted.groupBy("part").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).collect()}
    pos, n = (sum(x[i] for x in size.values()) for i in range(2))
    counts = _counts(parted)
    words, beginnings = _entries(counts, pos, n)
    got = [_scanned(parted.where(F.col("part") == k).drop("part"), *_entries(counts.where(F.col("part") != k), pos - a, n - b)).toArrow() for k, (a, b) in sorted(size.items())]
    y, total = (np.concatenate([g.column(c).to_numpy() for g in got] or [np.empty(0)]) for c in ("y", "total"))
    y = y.astype(int)
    order = np.lexsort((y, total))
    a, b = logistic(np.log1p(total[order]), y[order]) if y.any() else (1.0, -2.0)
    return Model(words, beginnings, (max(a, 0.1), min(b, -0.1)))


def predict(documents: DataFrame, model: Model, held: Column) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        s = Scanner(m.words, m.beginnings)
        for b in batches:
            found = [s.document(t) for t in b.column(2).to_pylist()]
            score = chance(np.log1p(np.array([f[0] for f in found])), m.ab)
            cols = [b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32)), pa.array([f[1] for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in OUT.split(", ")])

    return in_text_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, OUT)


def clean(documents: DataFrame, model: Model) -> DataFrame:
    """documents without the rows that are predicted toxic; rows go through whole, nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        s = Scanner(m.words, m.beginnings)
        for b in batches:
            total = np.array([s.document(t)[0] for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(chance(np.log1p(total), m.ab) < CUT))

    return in_text_batches(documents).mapInArrow(run, documents.schema)


def model_for(documents: DataFrame, labels: DataFrame) -> Model:
    return train(drawn(documents, labels, "toxic", SAMPLE, ~fold(5)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return predict(d, model_for(d, table(spark, sf_dir, "labels")), fold(5))
