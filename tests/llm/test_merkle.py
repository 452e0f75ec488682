import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF, awkward
from tidemark.llm import merkle as m
from tidemark.llm.common import table
from tidemark.llm.ranks import ranked


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(nodes):
    """Root, and for each node the runs that it goes through: (digests before it, after it)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, i in enumerate(at):
            paths[k].append(("".join(runs[i // 3][: i % 3]), "".join(runs[i // 3][i % 3 + 1 :])))
        at, level = [i // 3 for i in at], [sha("".join(r)) for r in runs]
    return (level[0] if level else None), paths


def brute(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, outer = tree([own[s][0] for s in names])
    out = []
    for s, up in zip(names, outer):
        for (_, _, h, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), own[s][1]):
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            folded = leaf(r, r.text.replace("\n", "") if changed and r.text is not None else r.text)
            for left, right in path + up:
                folded = sha(left + folded + right)
            out.append((r.doc_id, h, own[s][0], root, sha("".join(a + b for a, b in path + up)), folded, folded == root))
    return sorted(out, key=str)


def got(spark, docs, tmp_path, monkeypatch, depth):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(m, "manifest", lambda rows, f=m.manifest: f(rows, depth=depth))
    return sorted(map(tuple, m.op11_merkle(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("depth", [1, 2, m.DEPTH])
def test_awkward_rows_and_any_bucket(spark, tmp_path, monkeypatch, depth):
    docs = awkward(spark)
    assert got(spark, docs, tmp_path, monkeypatch, depth) == brute(docs)


def test_hot_source_of_many_copies(spark, tmp_path, monkeypatch):
    """One source of half of the rows, rows alike in all, sources of one row, and buckets of nine places: three trees on top of each other."""
    docs = spark.range(700).select(
        F.when(F.col("id") < 150, F.lit(5)).otherwise(F.col("id") % 400 - 3).alias("doc_id"), F.when(F.col("id") < 400, "hot").when(F.col("id") < 600, F.concat(F.lit("s"), F.col("id") % 60)).otherwise(F.concat(F.lit("é"), "id")).alias("source"),
        F.lit("en").alias("lang"), F.lit(None).cast("long").alias("n_chars"), F.concat(F.lit("a\n"), (F.col("id") % 7).cast("string")).alias("text"), F.lit(1).alias("h"), F.lit(2).alias("pos"),
    )
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 5, "a\nb").otherwise(F.col("text")))
    assert got(spark, docs, tmp_path, monkeypatch, 2) == brute(docs)


def test_matches_sql_and_empty_tables(spark, tmp_path):
    d = duckdb.connect()
    d.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = m.op11_merkle(spark, SF)
    found = d.execute(m.oracle())
    assert rows.columns == [c[0] for c in found.description]
    assert sorted(map(tuple, rows.collect())) == sorted(found.fetchall())
    assert m.manifest(m.leaves(table(spark, SF, "documents").limit(0))).count() == 0


def test_ranked_totals_and_places(spark):
    df = spark.range(3000).select((F.col("id") % 3 % 2).alias("g"), F.when(F.col("id") % 50 > 0, F.col("id") % 700).alias("o"), (F.col("id") % 11).alias("x")).repartition(7)
    df = df.withColumn("g", F.when(F.col("g") == 1, F.col("g")))
    rows = ranked(df, ["g"], ["o", "x"], ["x"]).collect()
    for g in (None, 1):
        own = sorted((r for r in rows if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(len(own))) and {r.group_rows for r in own} == {len(own)}
        assert [(r.o is not None, r.o or 0, r.x) for r in own] == sorted((r.o is not None, r.o or 0, r.x) for r in own)
        total = 0
        for r in own:
            total += r.x
            assert r.run_x == total
