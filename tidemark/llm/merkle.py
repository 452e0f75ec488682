"""Merkle manifest of a dataset: a tree of digests per group, and one tree over the groups.

Nodes in a row are joined in runs of FAN (the last run has fewer, even one) until one is left: the group's
subroot. Subroots, by group, are joined alike to the root. A leaf's proof is a struct
(left, right) for every level up to the root: the digests beside its node in the run.

1. Leaves are digests of the rows' fields, made by built-in functions; only digests go on.
2. `ranked` gives every leaf its place in its group by distributed counts, so a group may have any size.
3. A bucket is an aligned block of BLOCK = FAN ** DEPTH places. Tasks get whole buckets in Arrow batches and hand several
   at a time to DuckDB, where each level is one query of ordered string_agg and sha256.
4. Spark makes the buckets' roots the next nodes and goes on until a group has one; then groups are the nodes.
5. On the way back every bucket is joined by the proof of its root, and DuckDB puts the levels inside before it.

Null group: a group of its own, the first. Null order values come first; equal ones are ordered by leaf. Repeated rows
are leaves each. An empty table gives no rows. Extra columns of the documents are ignored; those of
leaves() are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .ranks import ranked

FAN, DEPTH = 3, 8
#: Rows that a task hands to DuckDB at once, in whole buckets; rows that a task has at most, about.
ENGINE_ROWS, TASK_ROWS = 20_000, 1_000_000
STEP = "struct<left:string,right:string>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined(columns: Sequence[Column]) -> Column:
    """SHA-256 of values one after the other, each as its number of UTF-8 bytes, `:` and itself, or `-` if null."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """The proof's digests one after the other, from the leaf's level up, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def _levels(depth: int) -> str:
    """CTEs n0 .. n<depth> of nodes (b, i, h, depth): bucket, place in it, digest, levels that the bucket has."""
    up = "n{1} AS MATERIALIZED (SELECT b, i // {2} AS i, CASE WHEN any_value(depth) > {0} THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, any_value(depth) AS depth FROM n{0} GROUP BY b, i // {2})"
    return ", ".join(["n0 AS MATERIALIZED (SELECT * FROM nodes)", *[up.format(k, k + 1, FAN) for k in range(depth)]])


def roots_sql(depth: int = DEPTH) -> str:
    return f"WITH {_levels(depth)} SELECT h FROM n{depth} ORDER BY b"


def proofs_sql(depth: int = DEPTH) -> str:
    """The proofs of nodes in order, from their buckets' own in `above` (b, proof)."""
    side = """s{0} AS (SELECT b, i, depth, coalesce(string_agg(h, '' ORDER BY i) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(h, '' ORDER BY i) OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM n{0} WINDOW r AS (PARTITION BY b, i // {1} ORDER BY i))"""
    down = "p{0} AS MATERIALIZED (SELECT s.b, s.i, CASE WHEN s.depth > {0} THEN list_prepend(struct_pack(\"left\" := s.l, \"right\" := s.r), p.proof) ELSE p.proof END AS proof FROM s{0} s JOIN p{1} p ON p.b = s.b AND p.i = s.i // {2})"
    steps = [x for k in range(depth - 1, -1, -1) for x in (side.format(k, FAN), down.format(k, k + 1, FAN))]
    return f"WITH {', '.join([_levels(depth), f'p{depth} AS (SELECT b, 0 AS i, proof FROM above)', *steps])} SELECT proof FROM p0 ORDER BY b, i"


def _whole_buckets(batches: Iterator[pa.RecordBatch], starts) -> Iterator[pa.Table]:
    """Tables of whole buckets, of ENGINE_ROWS rows or little more; starts(table) is true where a bucket begins."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ENGINE_ROWS:
            t = pa.Table.from_batches(held)
            begins = starts(t).to_numpy(zero_copy_only=False).nonzero()[0]
            cut = int(begins[-1])
            if cut:
                yield t.slice(0, cut)
            held, rows = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _engine():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})


def _nodes(t: pa.Table, begins, block: int) -> pa.Table:
    import numpy as np

    pos = t["pos"].to_numpy()
    return pa.table({"b": pa.array(np.cumsum(begins) - 1), "i": pa.array(pos % block), "h": t["h"].combine_chunks(), "depth": t["depth"]})


def _in_buckets(nodes: DataFrame, groups: Sequence[str], parts: int, *first: Column) -> DataFrame:
    return nodes.repartition(parts, *groups, "block").sortWithinPartitions(*groups, "block", "pos", *first)


def _parts(nodes: DataFrame) -> tuple[int, int]:
    """Tasks to deal nodes over, and the rows of the largest group."""
    n, most = nodes.agg(F.count(F.lit(1)), F.max("group_rows")).first()
    return max(nodes.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), most or 0


def _with_depth(nodes: DataFrame, depth: int) -> DataFrame:
    """block and depth: FAN ** depth places a block; a group within one block ends where one node is left."""
    levels = sum(((F.col("group_rows") > FAN**k).cast("int") for k in range(depth)), F.lit(0))
    return nodes.withColumns({"block": F.expr(f"pos div {FAN**depth}L"), "depth": levels})


def _roots(nodes: DataFrame, groups: Sequence[str], parts: int, depth: int) -> DataFrame:
    """groups, pos, group_rows, h: a row per bucket, which is a node of the next tree."""
    block = FAN**depth
    d = _with_depth(nodes.select(*groups, "pos", "group_rows", "h"), depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        at = lambda t: pc.equal(t["pos"], pc.multiply(t["block"], block))
        with _engine() as db:
            for t in _whole_buckets(batches, at):
                begins = at(t).to_numpy().astype(bool)
                db.register("nodes", _nodes(t, begins, block))
                h = db.sql(roots_sql(depth)).to_arrow_table()["h"]
                own = t.take(pa.array(begins.nonzero()[0])).select([*groups, "block", "group_rows"])
                yield from own.append_column("h", h).combine_chunks().to_batches()

    keys = [f"`{g}` {t}" for g, t in d.dtypes if g in groups]
    out = _in_buckets(d, groups, parts).mapInArrow(run, ", ".join([*keys, "block long, group_rows long, h string"]))
    return out.select(*groups, F.col("block").alias("pos"), F.expr(f"(group_rows + {block - 1}L) div {block}L").alias("group_rows"), "h")


def _proven(nodes: DataFrame, above: DataFrame, groups: Sequence[str], parts: int, depth: int) -> DataFrame:
    """nodes with proof, subroot and root, from above: those of the buckets (pos: the bucket's place). One shuffle of the nodes."""
    block = FAN**depth
    d = _with_depth(nodes, depth)
    top = above.select(*groups, F.col("pos").alias("block"), (F.col("pos") * block).alias("pos"), "proof", "subroot", "root")
    columns = nodes.columns
    both = d.withColumn("_own", F.lit(True)).unionByName(top.withColumn("_own", F.lit(False)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        with _engine() as db:
            for t in _whole_buckets(batches, lambda t: pc.invert(t["_own"])):
                own = t["_own"].to_numpy().astype(bool)
                bucket = np.cumsum(~own) - 1
                tops = t.filter(pa.array(~own))
                db.register("above", pa.table({"b": pa.array(np.arange(tops.num_rows)), "proof": tops["proof"]}))
                rows = t.filter(pa.array(own))
                b = bucket[own]
                db.register("nodes", _nodes(rows, np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else own[:0], block))
                found = {"proof": db.sql(proofs_sql(depth)).to_arrow_table()["proof"].cast(t.schema.field("proof").type), **{c: tops[c].take(pa.array(b)) for c in ("subroot", "root")}}
                out = pa.table([*[rows[c] for c in columns], *found.values()], names=[*columns, *found])
                yield from out.combine_chunks().to_batches(max_chunksize=2000)

    kinds = ", ".join(f"`{c}` {t}" for c, t in nodes.dtypes)
    return _in_buckets(both, groups, parts, F.col("_own")).mapInArrow(run, f"{kinds}, proof array<{STEP}>, subroot string, root string")


def _above(nodes: DataFrame, groups: Sequence[str], depth: int) -> DataFrame:
    """For every bucket of nodes: groups, pos (the bucket's place), and its root's proof, the group's subroot, the root."""
    parts, _ = _parts(nodes)
    roots = written(_roots(nodes, groups, parts, depth))
    again, most = _parts(roots)
    if most > 1:
        return written(_proven(roots, _above(roots, groups, depth), groups, again, depth).select(*groups, "pos", "proof", "subroot", "root"))
    if groups:
        tops = written(ranked(roots.select(*groups, "h"), [], groups))
        top = _proven(tops, _above(tops, [], depth), [], _parts(tops)[0], depth)
        return written(top.select(*groups, F.lit(0).cast("long").alias("pos"), "proof", F.col("h").alias("subroot"), "root"))
    return roots.select("pos", F.array().cast(f"array<{STEP}>").alias("proof"), F.col("h").alias("subroot"), F.col("h").alias("root"))


def leaves(documents: DataFrame, fields: Sequence[str] = FIELDS, **more: Column) -> DataFrame:
    """The rows' leaves, with doc_id, source and columns more; a column in more is a leaf's claim of its own, made of the row."""
    return documents.select("doc_id", "source", joined([F.col(f) for f in fields]).alias("leaf"), *[c.alias(n) for n, c in more.items()])


def manifest(rows: DataFrame, group: str = "source", order: str = "doc_id", leaf: str = "leaf", depth: int = DEPTH) -> DataFrame:
    """rows with proof, subroot and root; depth: levels that a bucket has."""
    kept = written(rows)
    placed = written(ranked(kept, [group], [order, leaf]).withColumn("h", F.col(leaf)))
    return _proven(placed, _above(placed, [group], depth), [group], _parts(placed)[0], depth).drop("pos", "group_rows", "h")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and whether each one proves itself after tampering."""
    d = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = joined([F.col(f) if f != "text" else F.replace(F.col(f), F.lit("\n")) for f in FIELDS])
    m = manifest(leaves(d, found=F.when(tampered & F.contains("text", F.lit("\n")), changed)))
    m = m.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), fold(F.coalesce("found", "leaf"), F.col("proof")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(text: str) -> str:
    byte = "list_reduce(list_prepend(c, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda x, y: {byte.replace('list_prepend(c,', 'list_prepend(xor(x, y),')}), 4294967295)"


def oracle(inner: int = 20, outer: int = 12) -> str:
    """The same in plain SQL: a level a CTE."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, FIELDS[:-1]), field(text)]) + ")"

    def tree(name: str, keys: str, depth: int) -> list[str]:
        """name0 (keys, i, h) joined level by level: sides name_s<k> and the last level."""
        same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.split(", "))
        out = []
        for k in range(depth):
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {keys}, i // 3 AS i, any_value(n) AS n, CASE WHEN any_value(n) > {3**k} THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY {keys}, i // 3)")
            out.append(f"""{name}_s{k} AS MATERIALIZED (SELECT {keys}, i, n > {3**k} AS up, coalesce(string_agg(h, '' ORDER BY i) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(h, '' ORDER BY i) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WINDOW w AS (PARTITION BY {keys}, i // 3 ORDER BY i))""")
        for k in range(depth):
            last = f"{name}_f{k}" if k else f"{name}_start"
            out.append(f"""{name}_f{k + 1} AS MATERIALIZED (SELECT a.* REPLACE (a.i // 3 AS i, CASE WHEN b.up THEN a.proof || b.l || b.r ELSE a.proof END AS proof, CASE WHEN b.up THEN sha256(b.l || a.folded || b.r) ELSE a.folded END AS folded)
                FROM {last} a JOIN {name}_s{k} b ON {same} AND a.i = b.i)""")
        return out

    ctes = [
        f"""d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS folded FROM documents)""",
        "t0 AS MATERIALIZED (SELECT *, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, '' AS proof FROM d)", "t_start AS (SELECT * FROM t0)",
        *tree("t", "source", inner),
        f"g0 AS MATERIALIZED (SELECT 0 AS one, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t{inner})",
        f"g_start AS (SELECT 0 AS one, a.doc_id, a.leaf, b.i, b.h AS subroot, a.proof, a.folded FROM t_f{inner} a JOIN g0 b ON a.source IS NOT DISTINCT FROM b.source)",
        *tree("g", "one", outer),
    ]
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b.h AS verified FROM g_f{outer} JOIN g{outer} b USING (one)"
