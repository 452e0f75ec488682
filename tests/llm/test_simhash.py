import random
import re

import xxhash

from tests.llm.helpers import SF, awkward
from tidemark.llm import simhash as s
from tidemark.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in sh]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute(rows):
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in rows), key=str)


def got(docs):
    return sorted((tuple(r) for r in s.simhash_classes(docs).collect()), key=str)


def test_matches_brute_force(spark):
    d = table(spark, SF, "documents")
    assert got(d) == brute([(r.doc_id, fp(r.text)) for r in d.collect()])


def test_awkward_rows(spark):
    d = awkward(spark)
    assert got(d) == brute([(r.doc_id, fp(r.text)) for r in d.collect()])
    assert s.one_of_each(d).columns == d.columns
    assert s.one_of_each(d).where("doc_id = 8").count() == 1
    assert got(d.limit(0)) == []


def test_chains_are_followed(spark):
    rng = random.Random(1)
    x, prints = rng.getrandbits(63), []
    for _ in range(60):
        prints.append(x)
        for j in rng.sample(range(63), 2):
            x ^= 1 << j
    prints += [rng.getrandbits(63) for _ in range(50)] + prints[:9]
    rows = list(enumerate(prints))
    c = s.classes(spark.createDataFrame(rows, "doc_id long, fp long"))
    assert sorted(((r.doc_id, f"{r.fp:016x}", r.component_id) for r in c.collect()), key=str) == brute(rows)


def test_half_of_all_in_one_class(spark):
    """A chain of fingerprints, each many times: half of all rows are one class, a quarter of them one fingerprint."""
    rng = random.Random(2)
    chain = [(1 << k) - 1 for k in range(0, 62, 2)]
    prints = chain * 20 + [chain[0]] * 600 + [rng.getrandbits(63) for _ in range(1200)]
    rows = [(i if i % 7 else None, f) for i, f in enumerate(prints)]
    c = s.classes(spark.createDataFrame(rows, "doc_id long, fp long").repartition(5))
    assert sorted(((r.doc_id, f"{r.fp:016x}", r.component_id) for r in c.collect()), key=str) == brute(rows)
