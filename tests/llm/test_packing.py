import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import SF, awkward
from tidemark.llm import packing as p
from tidemark.llm.common import table


def check(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append([*t.encode(r.text or "", add_special_tokens=False).ids, 0])
    pieces, seqs = p.pack(docs).collect(), defaultdict(list)
    by = defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(by) == set(want)
    for d, rows in by.items():
        if len(want[d]) == 1:
            ids, at = want[d][0], 0
            for r in sorted(rows, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
                at += r.length
            assert at == len(ids)
        else:
            assert sum(r.length for r in rows) == sum(map(len, want[d]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and at & (at - 1) == 0


def test_round_trip(spark):
    check(table(spark, SF, "documents"))


def test_awkward_rows(spark):
    check(awkward(spark))
    assert p.pack(awkward(spark).limit(0)).count() == 0


def test_odd_white_space_and_specials(spark):
    texts = ["a  b", " lead", "trail ", "x\n\n y", "tab\t z", " nb sp x", "it's we'll 12 34x 5.6", "a<|endoftext|>b", "\r\n", "é \U0001f642 ok", "", " ", "\n x \n"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_hilbert_steps_are_neighbours():
    g = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    k = p.hilbert(g, 3)
    assert sorted(k) == list(range(512))
    assert (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(1) == 1).all()


def test_neighbours_along_the_curve_are_alike():
    """Documents of five kinds, each with words of its own: most lie beside one of their kind, a fifth would by chance."""
    rng = np.random.default_rng(2)
    kinds = [rng.integers(1, 50_000, 40) for _ in range(5)]
    own = [(k, np.append(rng.choice(kinds[k], 200), 0).astype(np.uint16)) for k in rng.integers(0, 5, 400)]
    order = np.argsort(p.keys_of([ids for _, ids in own]), kind="stable")
    beside = [own[a][0] == own[b][0] for a, b in zip(order, order[1:])]
    assert np.mean(beside) > 0.6
    same = p.keys_of([own[0][1], own[0][1][::-1], own[1][1]])
    assert same[0] == same[1]


def test_keys_match_plain_means():
    few = [np.array([5, 5, 0]), np.array([70_000 % 65_536, 9, 12, 0]), np.array([0])]
    signs = np.random.default_rng(7).standard_normal((1 << 16, p.DIMS)).astype(np.float32)
    want = [p.hilbert(np.array([[int((np.tanh(3 * np.mean([signs[i][d] for i in ids])) + 1) / 2 * 255) for d in range(p.DIMS)]]))[0] for ids in few]
    assert list(p.keys_of(few)) == want


def test_little_padding_and_spread_of_copies(spark):
    copies = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words again and again " * 8).alias("text"))
    sizes = [r.n for r in p.pack(copies, size=64).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(n < 64 for n in sizes) <= 6 * 8 and sum(sizes) == 3000 * p.pack(copies.limit(1)).agg(F.max("doc_tokens")).first()[0]
