import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import SF
from tidemark.llm import trie as t

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        made[c] = turns.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    ends = {node: ",".join(map(str, sorted(c for c in m if len(made[c]) == len(node)))) for node, m in members.items()}
    out = [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()]
    return sorted(out, key=str)


def check(spark, rows, *how):
    df = spark.createDataFrame([(*r, "k", "d") for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, t.trie(*t.rebuilt(df), *how).collect()), key=str) == brute(rows)


AWKWARD = [
    (0, 0, "user", "hi"), (0, 1, "assistant", None), (0, None, None, "first"), (1, 0, "user", "x"), (2, 5, "user", "hi"), (2, 5, "user", "hi"), (2, 5, "user", "ha"), (2, 5, "assistant", "z"),
    (None, 0, "user", "lost"), (7, 0, "user", "no base"), (-3, 0, "user", "hi"), (-3, 1, "assistant", ""), (10, 1, "us", "erhi"), (11, 0, "user", "long " * 50_000), (13, 0, "", ""), (20, 0, "user", "é🙂"), (21, None, "user", "y"), (24, 2, "", "x"),
]


def test_awkward_rows(spark):
    check(spark, AWKWARD)
    check(spark, AWKWARD, 4, 2)
    assert t.trie(*t.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0
    check(spark, [(4, 0, "user", "alone")])


@pytest.mark.parametrize("how", [(), (300, 4), (40, 3)])
def test_hot_turns_copies_and_long_conversations(spark, monkeypatch, how):
    """Half of all start alike, many are copies, two long ones are alike up to their last turn, one long one is alone."""
    for name, v in (("ID_ROWS", 7), ("SALT_ROWS", 10), ("CHUNK_ROWS", 60)):
        monkeypatch.setattr(t, name, v)
    rng = np.random.default_rng(5)
    rows = [(c, i, "user" if i % 2 else "system", f"{rng.integers(0, 3)}" if i else ("hot" if c % 2 else f"{c % 5}")) for c in range(160) for i in range(rng.integers(1, 9))]
    rows += [(200 + c, i, "user", f"copy {i}") for c in range(0, 90) for i in range(3)]
    rows += [(c, i, "user", f"long {i}" + ("!" if i == 120 and c == 500 else "")) for c in (400, 500) for i in range(121)] + [(600, i, "user", f"own {i}") for i in range(150)]
    check(spark, rows, *how)


def test_matches_sql(spark):
    d = duckdb.connect()
    d.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    rows, found = t.op13_trie(spark, SF), d.execute(t.ORACLE)
    assert rows.columns == [c[0] for c in found.description]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(found.fetchall(), key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-1, 30), min_size=1, max_size=40), st.randoms())
def test_louds_bits_parents_and_totals(parents, random):
    parents = [min(p, i - 1) for i, p in enumerate(parents)]
    level = []
    for p in parents:
        level.append(level[p] + 1 if p >= 0 else 0)
    mixed = list(range(len(parents)))
    random.shuffle(mixed)
    at = {row: k for k, row in enumerate(mixed)}
    parent = np.array([at[parents[r]] if parents[r] >= 0 else -1 for r in mixed])
    trie = t.Louds(parent, np.array([level[r] for r in mixed]), np.array([f"{r:02d}" for r in mixed], dtype=object))
    assert trie.bits.sum() == len(parents) and len(trie.bits) == 2 * len(parents) + 1
    up = trie.parents()
    assert [mixed[trie.order[u]] if u >= 0 else -1 for u in up] == [parents[mixed[o]] for o in trie.order]
    assert [parents.count(mixed[o]) for o in trie.order] == list(trie.degrees())
    want = [1] * len(parents)
    for r in range(len(parents) - 1, -1, -1):
        if parents[r] >= 0:
            want[parents[r]] += want[r]
    assert list(trie.rolled(np.ones((len(parents), 1), dtype=np.int64))[:, 0]) == [want[mixed[o]] for o in trie.order]
    siblings = [[mixed[o] for o, u in zip(trie.order, up) if u == k] for k in range(-1, len(parents))]
    assert all(s == sorted(s) for s in siblings)
