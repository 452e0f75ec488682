"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams: of words (1 and 2), of runs of character classes
with their rough lengths (1 to 4), and of places where a word follows itself. Each is scaled by its class log-count
ratio, rows are scaled to length 1, and a linear hinge-loss model is fitted by dual coordinate descent;
its weights are interpolated with their mean size. Margins become probabilities by a logistic fitted on a fifth of the sample.

The sample is SAMPLE labelled documents at most, about, with their whole texts. Null text counts as empty and is scored like any text. Without labelled rows of both
classes the score is the share of label 1, or 0.5 without any. Labels that are null or neither 0 nor 1
are ignored; of several labels of one document the largest counts. Repeated rows each return a row;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_text_batches, table
from .labelled import chance, drawn, fold, logistic

BITS = 16
SAMPLE = 4000
CUT = 0.3
SMOOTH, C, PASSES, INTERPOLATE = 1.0, 1.0, 20, 0.75
LOWER, UPPER, DIGIT, SPACE, LINE, OTHER = 1, 2, 3, 4, 5, 6
_ODD = np.uint64(0x9E3779B97F4A7C15)
OUT = "doc_id long, held_out boolean, score double, predicted int"


@cache
def _classes() -> np.ndarray:
    """Class of each code point of the basic plane; punctuation and symbols of ASCII are classes of their own."""
    c = np.full(1 << 16, OTHER, dtype=np.uint8)
    for i in range(0x3000):
        kind = unicodedata.category(chr(i))
        c[i] = LINE if i == 10 else SPACE if i in (9, 11, 12, 13, 32) or kind == "Zs" else UPPER if kind in ("Lu", "Lt") else LOWER if kind[0] == "L" else DIGIT if kind[0] == "N" else i if i < 127 and i > 32 else OTHER
    return c


@cache
def _powers() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _grams(tokens: np.ndarray, orders: range, salt: int) -> list[np.ndarray]:
    out, h = [], np.full(len(tokens), salt, dtype=np.uint64)
    for k in range(orders.stop - 1):
        if len(tokens) <= k:
            break
        h = h[: len(tokens) - k] * _ODD + tokens[k:] + np.uint64(1)
        if k + 1 >= orders.start:
            x = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((x >> np.uint64(64 - BITS)).astype(np.int32))
    return out


class Features:
    def __init__(self):
        self.mark = np.zeros(1 << BITS, dtype=bool)

    def of(self, text: str) -> np.ndarray:
        """Sorted indices of the indicators that are set."""
        p = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        if not len(p):
            return np.zeros(1, dtype=np.int64)
        c = np.where(p < 1 << 16, _classes()[np.minimum(p, (1 << 16) - 1)], OTHER)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1])
        size = np.diff(np.concatenate([starts, [len(c)]]))
        runs = c[starts].astype(np.uint64) * np.uint64(8) + np.minimum(np.log2(size).astype(np.uint64), 5)
        found = _grams(runs, range(1, 5), 1)
        gap = (c == SPACE) | (c == LINE)
        inside = np.flatnonzero(~gap)
        if len(inside):
            first = np.flatnonzero(np.concatenate([[True], np.diff(inside) > 1]))
            place = np.arange(len(inside)) - np.repeat(first, np.diff(np.concatenate([first, [len(inside)]])))
            words = np.add.reduceat((p[inside].astype(np.uint64) + np.uint64(1)) * _powers()[place & 255], first)
            found += _grams(words, range(1, 3), 2)
            again = words[1:] == words[:-1]
            if again.any():
                found += [g[again[: len(g)]] for g in _grams(again.astype(np.uint64), range(1, 5), 3)]
        self.mark[np.concatenate(found)] = True
        at = np.flatnonzero(self.mark)
        self.mark[at] = False
        return at


class Model:
    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, ab: tuple[float, float]):
        self.square, self.product, self.bias, self.ab = (ratio * ratio).astype(np.float32), (ratio * weight).astype(np.float32), bias, ab

    def margin(self, at: np.ndarray) -> float:
        return float(self.product[at].sum(dtype=np.float64) / max(1e-9, np.sqrt(self.square[at].sum(dtype=np.float64)))) + self.bias


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, width: int, c: float = C, passes: int = PASSES, seed: int = 3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: weights and the bias (a feature of value 1). y: -1 or 1."""
    w, bias, alpha = np.zeros(width), 0.0, np.zeros(len(rows))
    q = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (values[i] @ w[rows[i]] + bias) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), c)
            if (d := new - alpha[i]) != 0:
                w[rows[i]] += d * y[i] * values[i]
                bias += d * y[i]
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w, bias


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """rows: indices of each document's indicators; y: 0 or 1."""
    width = 1 << BITS
    none = np.zeros(width)
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Model(none, none, 0.0, (0.0, float(np.log(p / (1 - p)))))
    spare = np.arange(len(y)) % 5 == 4
    if len(set(y[~spare].tolist())) < 2:
        spare[:] = False

    def solve(use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        count = {k: np.full(width, SMOOTH) for k in (0, 1)}
        for i in np.flatnonzero(use):
            count[y[i]][rows[i]] += 1
        ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
        values = [ratio[rows[i]] / max(1e-9, np.linalg.norm(ratio[rows[i]])) for i in np.flatnonzero(use)]
        w, bias = descend([rows[i] for i in np.flatnonzero(use)], values, 2.0 * y[use] - 1, width)
        mean = np.abs(w).mean()
        return ratio, (1 - INTERPOLATE) * mean + INTERPOLATE * w, bias

    trial = Model(*solve(~spare), (1.0, 0.0))
    judged = spare if spare.any() else ~spare
    ab = logistic(np.array([trial.margin(rows[i]) for i in np.flatnonzero(judged)]), y[judged])
    return Model(*solve(np.ones(len(y), dtype=bool)), ab)


def train(sample: DataFrame) -> Model:
    """sample: doc_id, text, y. Features are made in tasks; the indices of a bounded sample come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in batches:
            at = pa.array([f.of(t).tolist() for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), at], names=["doc_id", "y", "at"])

    got = in_text_batches(sample).mapInArrow(run, "doc_id long, y int, at array<int>").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    at = got.column("at").combine_chunks()
    rows = [np.asarray(at[int(i)].values) for i in order]
    return fit(rows, got.column("y").to_numpy()[order].astype(int))


def predict(documents: DataFrame, model: Model, held: Column) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, m = Features(), shared.value
        for b in batches:
            score = chance(np.array([m.margin(f.of(t or "")) for t in b.column(2).to_pylist()]), m.ab)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return in_text_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, OUT)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, held = table(spark, sf_dir, "documents"), fold(5)
    return predict(d, train(drawn(d, table(spark, sf_dir, "labels"), "quality", SAMPLE, ~held)), held)
