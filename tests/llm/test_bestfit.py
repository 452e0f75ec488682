import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import SF, awkward
from tidemark.llm import bestfit as b
from tidemark.llm import wordids
from tidemark.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = wordids.loaded(PATH)


def same(texts):
    want = [e.ids for e in WORDS.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in WORDS.ids(texts)] == want


def test_ids_of_every_character_in_several_places():
    assert WORDS.by_words
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    same([f"a{c}b  {c} 1{c}{c}'s {c.upper()}X'{c}" for c in chars])


def test_ids_of_long_runs_and_added_tokens():
    same([" " * 100_000, "ab" * 50_000, "#'" * 50_000, "x <|endoftext|> y", "", " \n\t", "İI ΑΣ ΑΣ. é", "'S 'rEally we'Ll 12½", "\x1c \x85 \xa0x"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("aB cé'sŁlL1²\n\t  #.!İ", max_size=60), max_size=8))
def test_ids_of_random_texts(texts):
    same(texts)


def test_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(wordids, "CACHE", 3)
    for _ in range(3):
        same(["one two three four five six", "seven two one"])


def plain(lengths, kind):
    """Best-fit by a scan over all bins ever made: what is left of each."""
    bins, cap = [], kind.capacity
    for n in lengths:
        d = (n, 1, n * n)
        can = [i for i, left in enumerate(bins) if all(x >= y for x, y in zip(left, d))]
        rest = lambda i: sum(w * (x - y) / c for w, x, y, c in zip(kind.weights, bins[i], d, cap))
        dot = lambda i: -sum(w * x * y / c / c for w, x, y, c in zip(kind.weights, bins[i], d, cap))
        value = {i: (rest if kind.choice == "norm" else dot)(i) for i in can}
        at = min(can, key=value.get) if can else len(bins)
        if not can:
            bins.append(list(cap))
        bins[at] = [x - y for x, y in zip(bins[at], d)]
    return bins


@pytest.mark.parametrize("kind", [b.Bin(), b.Bin(64, 5, 64 * 64), b.Bin(64, 64, 4096, (1.0, 0.3, 0.2)), b.Bin(64, 9, 4500, (1.0, 0.5, 0.5), "dot")])
def test_bins_are_those_of_a_plain_scan(kind):
    rng = np.random.default_rng(3)
    lengths = sorted((int(x) for x in np.minimum(rng.geometric(8 / kind.tokens, 900), kind.tokens)), reverse=True)
    ours, used, filled = b.Open(kind), defaultdict(list), defaultdict(int)
    for n in lengths:
        at, offset = ours.place(n)
        assert offset == filled[at]
        filled[at] += n
        used[at].append(n)
    for own in used.values():
        assert sum(own) <= kind.tokens and len(own) <= kind.documents and sum(n * n for n in own) <= kind.attention
    assert sorted(sum(x) for x in used.values()) == sorted(kind.tokens - int(x[0]) for x in plain(lengths, kind))


def check(docs, kind=None, **how):
    t = Tokenizer.from_file(PATH)
    kind = kind or b.Bin()
    want, got, seqs = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, i in enumerate(range(0, len(ids), kind.tokens)):
            own = np.array(ids[i : i + kind.tokens], dtype="<u4").tobytes()
            want[r.doc_id].append((k, i, len(own) // 4, zlib.crc32(own)))
    for r in b.pack(docs, kind=kind, **how).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        assert zlib.crc32(np.frombuffer(r.ids, dtype="<u2").astype("<u4").tobytes()) == r.ids_crc32
        seqs[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= kind.tokens and len(s) <= kind.documents and sum(n * n for _, n in s) <= kind.attention
    return seqs, sum(x[2] for own in want.values() for x in own)


def test_round_trip_and_few_sequences(spark):
    seqs, tokens = check(table(spark, SF, "documents"))
    assert len(seqs) <= 1.02 * tokens / b.SIZE + 1


def test_awkward_rows(spark):
    check(awkward(spark))
    check(awkward(spark), b.Bin(16, 3, 256))
    assert b.pack(awkward(spark).limit(0)).count() == 0


def test_many_tasks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(b, "PART_TOKENS", 4000)
    copies = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("the same words again and again " * 3)).alias("text"))
    seqs, tokens = check(copies, b.Bin(64, 64, 4096))
    assert len({s >> 40 for s in seqs}) >= 4 and len(seqs) <= 1.25 * tokens / 64
    again = [sorted(map(tuple, b.pack(table(spark, SF, "documents")).drop("ids").collect()), key=str) for _ in range(2)]
    assert again[0] == again[1]
