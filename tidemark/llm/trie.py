"""Prefix trie of conversations: which turns are shared by whom, and what a cache of shared prefixes saves.

A conversation's first d turns are a node, known by sums of hashes of (place, role, text): `ranked` adds them up over
any length of conversation, and a node's parent is the same sum without the last turn. Nodes are grouped once, which counts members.

Subtree totals come from succinct level-order tries. A node's weight is the number of turns in and below it. A shard is a
whole subtree of SHARD_ROWS weight at most; tasks get whole shards, lay them out in level order as a LOUDS bit vector (a one
for each child and a zero for each node) with arrays of labels and values, and add values to parents level by level from the deepest up.
Nodes heavier than a shard are merged separately: shards' totals, summed by parent, are values of a smaller trie of heavy
nodes, which is cut into shards of WIDER times the weight, until one shard holds the root. Turns that one
conversation has alone need no trie, however many: below the first of them nothing is shared.

Turns are ordered by turn (null first), then role and text. Null role and text: empty. Rows without a conv_id belong to no
conversation. Repeated rows are turns of their own. An empty table has no nodes. Extra columns are ignored. A task
holds the shared part of a conversation as numbers, so only copies of one of millions of turns would be too long for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .merkle import crc32_sql
from .ranks import ranked

#: Weight of a shard, how much more the next one holds, and rows that a task lays out at once.
SHARD_ROWS, WIDER, CHUNK_ROWS = 20_000, 1000, 50_000
#: Parts that a heavy node's children are joined in; turns of one conversation that are joined in one part; ids of a node hashed in one piece.
SALTS, SALT_ROWS, ID_ROWS = 16, 100_000, 500
FAMILY, HEADS = 5, 9
LANES = 4
ROOT = ".".join("0" * LANES)
NODE = "key string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent string, top boolean"


class Louds:
    """A forest in level order under one super-root: a one for each child and a zero for each node."""

    def __init__(self, parent: np.ndarray, level: np.ndarray, label: np.ndarray):
        """parent: each row's parent row, -1 for roots; level: from 0 at the roots; label: what orders siblings."""
        rank = np.empty(len(label), dtype=np.int64)
        rank[np.argsort(label, kind="stable")] = np.arange(len(label))
        place = np.full(len(parent) + 1, -1)  # the last: of the super-root
        by_level = np.argsort(level, kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(level, minlength=1))])
        for a, b in zip(self.starts, self.starts[1:]):
            rows = by_level[a:b]
            rows = rows[np.lexsort((rank[rows], place[parent[rows]]))]
            by_level[a:b], place[rows] = rows, np.arange(a, b)
        self.order = by_level
        degree = np.bincount(place[parent] + 1, minlength=len(parent) + 1)
        self.bits = np.zeros(len(parent) + len(degree), dtype=bool)
        ends = np.cumsum(degree + 1) - 1
        self.bits[:] = True
        self.bits[ends] = False

    def degrees(self) -> np.ndarray:
        """Children of every node, in level order."""
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros) - 1

    def parents(self) -> np.ndarray:
        """A node's parent is the number of zeros before its one, less the super-root."""
        return np.cumsum(~self.bits)[self.bits] - 1

    def rolled(self, values: np.ndarray) -> np.ndarray:
        """values (in level order, a column each) summed over subtrees."""
        out, parents = values.copy(), self.parents()
        for a, b in zip(self.starts[-2:0:-1], self.starts[:1:-1]):
            np.add.at(out, parents[a:b], out[a:b])
        return out


def _laid_out(t: pa.Table) -> pa.RecordBatch:
    """The nodes of whole shards with their subtrees' totals."""
    import pyarrow.compute as pc

    key, n = t["key"].combine_chunks(), t.num_rows
    num = lambda c: t[c].to_numpy().astype(np.int64)
    parent = pc.fill_null(pc.index_in(t["parent"].combine_chunks(), value_set=key), -1).to_numpy().astype(np.int64)
    depth, conv, own = num("depth"), num("conv_id"), num("n_convs")
    # Rows are sorted by shard and depth: a shard's first row is its root.
    first = np.maximum.accumulate(np.where(parent < 0, np.arange(n), 0))
    trie = Louds(parent, depth - depth[first], np.array(key.to_pylist(), dtype=object))
    o, up = trie.order, trie.parents()
    children = trie.degrees() + num("in_children")[o]
    values = np.stack([num("in_leaves")[o] + (children == 0), num("in_saved")[o] + (own[o] - 1) * num("bytes")[o]], axis=1)
    leaves, saved = trie.rolled(values).T
    above = pa.array(np.where(up >= 0, conv[o][up], 0), mask=up < 0)
    columns = [key.take(pa.array(o)), depth[o], conv[o], pc.coalesce(above, t["top_conv"].combine_chunks().take(pa.array(o))), own[o], children, leaves, saved, t["parent"].combine_chunks().take(pa.array(o)), up < 0]
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names=[c.split()[0] for c in NODE.split(", ")])


def _totals(nodes: DataFrame) -> DataFrame:
    """nodes (with shard and top_conv) laid out shard by shard: NODE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < CHUNK_ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            cut = pc.index(t["shard"], t["shard"][rows - 1]).as_py()  # the last shard may go on
            if cut:
                yield _laid_out(t.slice(0, cut))
            held, rows = t.slice(cut).to_batches(), rows - cut
        if rows:
            yield _laid_out(pa.Table.from_batches(held))

    return nodes.repartition("shard").sortWithinPartitions("shard", "depth").mapInArrow(run, NODE)


def _shards(light: DataFrame, heavy: DataFrame) -> DataFrame:
    """light with shard, the key of the highest light node above it, and top_conv, that node's parent's conv_id (only there).

    Children of heavy nodes may be many: they are joined in SALTS parts. Then a node takes its ancestor's ancestor, so
    rounds grow with the logarithm of the depth; a light node has SHARD_ROWS nodes below it at most.
    """
    above = heavy.select(F.col("key").alias("_up"), F.col("conv_id").alias("top_conv"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = light.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    rows = rows.join(above, (rows.parent == F.col("_up")) & (rows["_salt"] == above["_salt"]), "left").drop("_salt", "_up")
    rows = written(rows.withColumn("shard", F.when(F.col("top_conv").isNotNull(), F.col("key")).otherwise(F.col("parent"))))
    while True:
        step = rows.select(F.col("key").alias("_k"), F.col("shard").alias("_next"))
        rows = written(rows.join(step, F.col("shard") == F.col("_k")).drop("_k").withColumn("_moved", F.col("_next") != F.col("shard")).withColumn("shard", F.col("_next")).drop("_next"))
        if rows.where("_moved").isEmpty():
            return rows.drop("_moved")
        rows = rows.drop("_moved")


def rolled(nodes: DataFrame, shard_rows: int = SHARD_ROWS, wider: int = WIDER) -> DataFrame:
    """nodes (key, parent, depth, conv_id, n_convs, w, bytes, in_children, in_leaves) with subtree totals: NODE."""
    nodes, out, none = nodes.withColumn("in_saved", F.lit(0).cast("long")), None, F.lit(None).cast("long")
    while True:
        heavy = written(nodes.where(F.col("w") > shard_rows))
        last = heavy.isEmpty()
        light = nodes.withColumns({"shard": F.lit(ROOT), "top_conv": none}) if last else _shards(nodes.where(F.col("w") <= shard_rows), heavy)
        done = written(_totals(light))
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        below = done.where("top").groupBy(F.col("parent").alias("_p")).agg(F.count(F.lit(1)).alias("_c"), F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        more = {to: F.col(to) + F.coalesce(x, F.lit(0)) for to, x in (("in_children", "_c"), ("in_leaves", "_l"), ("in_saved", "_s"))}
        nodes = written(heavy.join(below, F.col("key") == F.col("_p"), "left").withColumns(more).drop("_p", "_c", "_l", "_s"))
        shard_rows *= wider


def _ids_digest(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest of each key's conv_ids, ascending and comma-joined.

    Ids are put together in pieces of ID_ROWS; a key of several pieces is hashed piece by piece as they stream through its task.
    """
    p = ranked(ends, ["key"], ["conv_id"]).withColumn("chunk", F.expr(f"pos div {ID_ROWS}L"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    p = written(p.groupBy("key", "chunk", (F.col("group_rows") <= ID_ROWS).alias("one")).agg(ids.alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != now:
                    if digest:
                        yield done()
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if digest:
            yield done()

    many = p.where("not one").select("key", "chunk", "ids").repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(run, "key string, ends_sha256 string")
    return p.where("one").select("key", F.sha2("ids", 256).alias("ends_sha256")).unionByName(many)


def _key(columns: list[Column]) -> Column:
    return F.concat_ws(".", *[c.cast("string") for c in columns])


def trie(turns: DataFrame, conversations: DataFrame, shard_rows: int = SHARD_ROWS, wider: int = WIDER) -> DataFrame:
    """turns (conv_id, d from 1 without gaps, label: a digest of the turn, bytes) of conversations (conv_id, once each, turnless ones too) -> a row per node.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    digest = F.sha2(F.concat(F.col("d").cast("string"), F.lit(":"), F.col("label")), 256)
    lane = [F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"x{k}") for k in range(LANES)]
    xs = [f"x{k}" for k in range(LANES)]
    t = written(turns.withColumn("_h", digest).select("conv_id", "d", "bytes", *lane))
    runs = [F.col(f"run_{x}") for x in xs]
    t = ranked(t, ["conv_id"], ["d"], xs).select("conv_id", "d", "bytes", F.col("group_rows").alias("of"), _key(runs).alias("key"), _key([r - F.col(x) for r, x in zip(runs, xs)]).alias("parent"))
    t = written(t)
    whole = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = whole.crossJoin(t.agg(F.count(F.lit(1)).alias("_t")))  # a row each
    long = lambda x: F.lit(x).cast("long")
    root = root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), long(0).alias("depth"), long(0).alias("bytes"), "conv_id", "n_convs", (F.col("_t") + F.col("n_convs")).alias("w"))
    grouped = t.groupBy("key", "parent", F.col("d").alias("depth"), "bytes").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("of") - F.col("d") + 1).alias("w"))
    nodes = written(grouped)
    # A conversation's own tail: its first node is a leaf of the trie, the others follow from it.
    tail = nodes.where("n_convs = 1")
    tops = written(tail.groupBy("conv_id").agg(F.min_by(F.struct("key", "parent", "depth", "bytes", "n_convs", "w"), "depth").alias("_x")).select("conv_id", "_x.*"))
    end = F.expr(f"(depth + w - 1) div {SALT_ROWS}L")
    salted = tops.select(F.col("conv_id").alias("_c"), F.col("depth").alias("_top"), F.explode(F.sequence(F.expr(f"depth div {SALT_ROWS}L"), end)).alias("_salt"))
    rest = tail.join(salted, (F.col("conv_id") == F.col("_c")) & (F.expr(f"depth div {SALT_ROWS}L") == F.col("_salt"))).where("depth > _top")
    rest = rest.select("key", "depth", "conv_id", F.col("conv_id").alias("parent_conv_id"), "n_convs", (F.col("w") > 1).cast("long").alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"))
    inner = nodes.where("n_convs > 1").unionByName(root).withColumns({"in_children": long(0), "in_leaves": long(0)})
    below = (F.col("w") > 1).cast("long")
    shared = written(inner.unionByName(tops.withColumns({"in_children": below, "in_leaves": below})))
    all_nodes = rolled(shared, shard_rows, wider).drop("parent", "top").unionByName(rest)
    ends = t.where("d = of").select("key", "conv_id")
    empty = conversations.join(t.where("d = 1").select("conv_id"), "conv_id", "left_anti").select(F.lit(ROOT).alias("key"), "conv_id")
    ids = _ids_digest(written(ends.unionByName(empty)))
    return all_nodes.join(ids, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


def ordered_turns(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), group_rows, label and bytes of every turn.

    Texts order turns only where conv_id, turn and role are the same, so only there they go through the sort.
    """
    r = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    tied = r.groupBy("conv_id", "turn", "role").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("role").alias("_r"))
    r = r.join(tied, (F.col("conv_id") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("role") == F.col("_r")), "left")
    label = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    r = r.select("conv_id", "turn", "role", label.alias("label"), F.octet_length("text").cast("long").alias("bytes"), F.when(F.col("_c").isNotNull(), F.col("text")).alias("_tie"))
    return ranked(written(r), ["conv_id"], ["turn", "role", "_tie"]).select("conv_id", "pos", "group_rows", "label", "bytes")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns and conversations (as of trie()) where each conversation begins with turns of its family's first.

    Conversation c takes the first h turns of c - c % FAMILY (all if it has fewer, none if it isn't there), then its own after its first h;
    h is the crc32 of its decimal id modulo HEADS.
    """
    own = written(ordered_turns(rows))
    first = F.col("conv_id") % FAMILY == 0
    c = own.where("pos = 0").select("conv_id", F.col("group_rows").alias("n"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    heads = own.where(first & (F.col("pos") < HEADS - 1)).select(F.col("conv_id").alias("base"), "pos", "label", "bytes", F.col("group_rows").alias("_of"))
    taken = c.where(~first).join(heads, "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("d"), "label", "bytes")
    bases = heads.where("pos = 0").select("base", "_of")
    start = F.when(first, 0).otherwise(F.least("h", F.coalesce("_of", F.lit(0))) - F.col("h"))
    info = c.join(bases, "base", "left").select(F.col("conv_id").alias("_c"), "h", start.alias("_shift"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SALT_ROWS}L"))).alias("_salt"))
    kept = own.join(info, (F.col("conv_id") == F.col("_c")) & (F.expr(f"pos div {SALT_ROWS}L") == F.col("_salt"))).where(first | (F.col("pos") >= F.col("h")))
    kept = kept.select("conv_id", (F.col("pos") + 1 + F.col("_shift")).alias("d"), "label", "bytes")
    return written(taken.unionByName(kept)), written(c.select("conv_id"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(table(spark, sf_dir, "conversations")))


ORACLE = f"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT DISTINCT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc32_sql('conv_id::VARCHAR')} % {HEADS} AS h FROM t),
    r AS (SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN t ON t.conv_id = c.base WHERE i < h UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t USING (conv_id) WHERE i >= h),
    p AS (SELECT *, row_number() OVER w AS d, count(*) OVER (PARTITION BY conv_id) AS l, string_agg(sha256(strlen(role) || ':' || role || text), '' ORDER BY own, i) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS said FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
    q AS MATERIALIZED (SELECT conv_id, d, l, strlen(text) AS bytes, sha256(said) AS key, coalesce(sha256(lag(said) OVER (PARTITION BY conv_id ORDER BY d)), '') AS parent FROM p
        UNION ALL SELECT c.conv_id, 0, coalesce(any_value(p.l), 0), 0, '', NULL FROM c LEFT JOIN p ON p.conv_id = c.conv_id GROUP BY 1),
    n AS MATERIALIZED (SELECT key, any_value(parent) AS parent, any_value(d) AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = l), '') AS ends FROM q GROUP BY key),
    k AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY 1),
    s AS (SELECT q.key, count(CASE WHEN k.key IS NULL THEN 1 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved FROM n JOIN q ON q.conv_id = n.conv_id AND q.d <= n.depth LEFT JOIN k ON k.key = n.key GROUP BY 1)
    SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, u.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM n JOIN s USING (key) LEFT JOIN k USING (key) LEFT JOIN n u ON u.key = n.parent"""
