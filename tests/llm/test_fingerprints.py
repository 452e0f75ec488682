import hashlib
import statistics

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import SF, awkward
from tidemark.llm import fingerprints as f
from tidemark.llm.common import table


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), xxhash.xxh64_intdigest(r[1].encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(r[1].encode(), 42) >> 63)))
    out = []
    for i, (d, t) in enumerate(rows):
        k, n = len(t) // 3, rows[(i + 1) % len(rows)][1]
        out.append((d, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs):
    return f.fingerprints(docs).collect()


def base(rows):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=str)


def test_matches_brute_force(spark):
    d = table(spark, SF, "documents")
    got, texts = run(d), {r.doc_id: r.text for r in d.collect()}
    assert base(got) == brute(texts.items())
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)
    long = [r for r in got if r.n_chars > 500]
    assert statistics.mean(r.near_edited for r in long) > 0.55
    assert statistics.mean(r.near_next for r in long) < 0.3


def test_awkward_rows(spark):
    d = awkward(spark)
    got = run(d)
    assert base(got) == brute([(r.doc_id, r.text) for r in d.collect()])
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert {r.fingerprint for r in got if r.doc_id == 1} == {r.fingerprint for r in got if r.doc_id == 7}
    assert run(d.limit(0)) == []
    one = run(d.where("doc_id = 1"))
    assert len(one) == 1 and one[0].near_next == 1


def test_order_and_increments(spark):
    texts = [(1, "a b c\nd e f\ng"), (2, "g\na b c\nd e f"), (3, "a b c\ng"), (4, "d e f")]
    got = {r.id: r for r in f.fingerprint_rows(spark.createDataFrame(texts, "id long, text string"), ["id"]).collect()}
    assert (got[1].exact, got[1].lanes, got[1].pieces) == (got[2].exact, got[2].lanes, got[2].pieces)
    assert [(a + b) % (1 << 32) for a, b in zip(got[3].exact, got[4].exact)] == got[1].exact
    assert [a + b for a, b in zip(got[3].lanes, got[4].lanes)] == got[1].lanes


@pytest.mark.parametrize("kind", ["outlier", "dense", "no ids", "one id"])
def test_ranges_are_even_wherever_ids_lie(spark, kind):
    """The largest range holds four times the mean at most; the rows stay those of the brute force."""
    ids = {"outlier": F.when(F.col("id") == 7, 1 << 60).otherwise(F.col("id")), "dense": F.when(F.col("id") % 3 == 0, F.col("id") * 10**15).otherwise(F.col("id")), "no ids": F.when(F.col("id") % 3 == 0, F.col("id")), "one id": F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(5))}
    docs = spark.range(6000).select(ids[kind].cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("text"), F.col("id") * 7919, F.lit("end of it")).alias("text"))
    sizes = [r["count"] for r in f.with_next(docs).groupBy("bucket").count().collect()]
    assert sum(sizes) == 6000 and len(sizes) > 60 and max(sizes) <= 4 * 6000 / len(sizes)
    few = docs.where("doc_id IS NULL OR doc_id % 5 = 0 OR doc_id > 100000")
    assert base(run(few)) == brute([(r.doc_id, r.text) for r in few.collect()])


def test_likeness_estimates_the_share_of_common_pieces(spark):
    """Against the exact multisets: 1 - difference / pieces of both, within a sketch's error."""
    import collections
    import random
    import re

    rng, rows, want = random.Random(3), [], []
    for k in range(40):
        lines = [" ".join(f"w{rng.randrange(400)}" for _ in range(12)) for _ in range(30)]
        other = lines[: 30 - k // 2] + [" ".join(f"v{rng.randrange(400)}" for _ in range(12)) for _ in range(k // 2)]
        rows.append((k, "\n".join(lines), "\n".join(rng.sample(other, 30))))
        a, b = (collections.Counter(p for x in t.split("\n") for p in re.findall(f.PIECE, x)) for t in rows[-1][1:])
        want.append(1 - sum(((a - b) + (b - a)).values()) / (a.total() + b.total()))
    pairs = spark.createDataFrame(rows, "k long, a string, b string")
    side = lambda c: f.fingerprint_rows(pairs.select("k", F.col(c).alias("text")), ["k"]).select("k", F.struct("pieces", "exact", "lanes").alias(c))
    got = {r.k: r.x for r in side("a").join(side("b"), "k").select("k", f.likeness("a", "b").alias("x")).collect()}
    assert got[0] == 1 and max(abs(got[k] - want[k]) for k in got) < 0.35 and abs(statistics.mean(got[k] - want[k] for k in got)) < 0.05
