import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward
from tidemark.llm import quality_model as q
from tidemark.llm.common import table
from tidemark.llm.labelled import drawn, fold, logistic

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    d, lab, held = table(spark, SF, "documents"), table(spark, SF, "labels"), fold(5)
    r = q.predict(d, q.train(drawn(d, lab, "quality", q.SAMPLE, ~held)), held)
    assert r.count() == 1000
    r = r.join(lab, "doc_id").where("held_out").collect()
    assert sum(x.predicted == x.quality for x in r) >= 0.95 * len(r)
    assert all(x.predicted == 1 for x in r if x.quality == 1)


def test_awkward_rows(spark):
    d = awkward(spark)
    lab = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, 1), (8, 0), (9, 1), (6, None), (None, 1), (2, 7)], "doc_id long, quality int")
    for labels in (lab, lab.limit(0), lab.where("quality = 1")):
        r = q.predict(d, q.train(drawn(d, labels, "quality", 100, fold(5) | ~fold(5))), fold(5)).collect()
        assert len(r) == 10 and all(0 <= x.score <= 1 for x in r)
    assert q.predict(d.limit(0), q.train(drawn(d, lab, "quality", 100, ~fold(5))), fold(5)).count() == 0


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.sign(x @ rng.normal(size=5) + 0.3 * rng.normal(size=60))
    w, b = q.descend([np.arange(5)] * 60, list(x), y, 5, passes=3000)
    primal = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = primal(w, b)
    for _ in range(300):
        assert primal(w + 0.02 * rng.normal(size=5), b + 0.02 * rng.normal()) >= best - 1e-3


def test_logistic_orders_and_stays_finite():
    m, y = np.array([-2.0, -1, 1, 2]), np.array([0, 0, 1, 1])
    a, b = logistic(m, y)
    assert 0 < a < 50 and abs(b) < 1
    assert logistic(np.zeros(0), np.zeros(0)) == (1.0, 0.0)


def symbols(text):
    """A text's features said plainly: n-grams of words, of runs of character classes, and of places where a word follows itself."""
    import itertools
    import math
    import unicodedata

    def kind(c):
        cat = unicodedata.category(c)
        if c == "\n":
            return "line"
        if c in "\t\v\f\r " or cat == "Zs":
            return "space"
        if ord(c) >= 0x3000:
            return "other"
        if cat in ("Lu", "Lt"):
            return "upper"
        if cat[0] == "L":
            return "lower"
        if cat[0] == "N":
            return "digit"
        return c if 32 < ord(c) < 127 else "other"

    runs = [(k, min(5, int(math.log2(len(list(g)))))) for k, g in itertools.groupby(map(kind, text))]
    words = "".join(" " if kind(c) in ("space", "line") else c for c in text).split(" ")
    words = [w for w in words if w]
    again = [a == b for a, b in zip(words, words[1:])]
    grams = lambda tag, xs, orders: {(tag, *xs[i : i + k]) for k in orders for i in range(len(xs) - k + 1)}
    found = grams("runs", runs, range(1, 5)) | grams("words", words, (1, 2))
    if any(again):
        found |= {("again", *again[i : i + k]) for k in range(1, 5) for i in range(len(again) - k + 1) if again[i]}
    return found


def test_features_match_plain_ones():
    """As many indicators as plain features, and as many in common for every pair of texts, up to a few hash collisions."""
    texts = ["The cat sat, the cat sat.", "the the the cat\n\nSAT 12 345!", "Ünter über\tstraße ÜBER", "a a b b a a", "日本 語 x", "%%% $$ ###", "x" * 70 + " " * 9 + "Y1", "one two three one two three one", "a\u00a0b c"]
    f = q.Features()
    got, want = [set(f.of(t).tolist()) for t in texts], [symbols(t) for t in texts]
    for i in range(len(texts)):
        assert abs(len(got[i]) - len(want[i])) <= 1, texts[i]
        for j in range(i):
            assert abs(len(got[i] & got[j]) - len(want[i] & want[j])) <= 1, (texts[i], texts[j])


def test_ratios_and_scores_match_a_plain_model():
    rng = np.random.default_rng(8)
    rows = [np.unique(rng.integers(0, 40, rng.integers(3, 12)) + 30 * (i % 2)) for i in range(60)]
    y = np.array([i % 2 for i in range(60)])
    m = q.fit(rows, y)
    width = 1 << q.BITS
    p = {k: [q.SMOOTH] * width for k in (0, 1)}
    for r, k in zip(rows, y):
        for j in r:
            p[k][j] += 1
    total = {k: sum(p[k]) for k in p}
    ratio = np.array([np.log(a / total[1]) - np.log(b / total[0]) for a, b in zip(p[1], p[0])])
    assert m.square == pytest.approx(ratio**2, rel=1e-5, abs=1e-9)
    values = [ratio[r] / np.sqrt(sum(ratio[j] ** 2 for j in r)) for r in rows]
    w, bias = q.descend(rows, values, 2.0 * y - 1, width)
    w = (1 - q.INTERPOLATE) * np.abs(w).mean() + q.INTERPOLATE * w
    for r, v in zip(rows, values):
        margin = sum(a * w[j] for a, j in zip(v, r)) + bias
        assert m.margin(r) == pytest.approx(margin, abs=1e-4)
    right = [(m.margin(r) > 0) == bool(k) for r, k in zip(rows, y)]
    assert np.mean(right) > 0.95


def test_the_sample_is_bounded_and_never_empty(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    n = drawn(docs, labels, "quality", 500, F.lit(True)).count()
    assert 400 < n < 600 and drawn(docs, labels, "quality", 4000, F.lit(True)).count() == 4000
    assert (4000 << 60) // 10**13 > 0
