"""Mixing sources to target weights over a tree of domains, languages and sources.

Budgets go down the tree in whole tokens. Children of a node share its budget in
proportion to their weights; a child whose documents (times MAX epochs) can't fill its share is
filled, and what is missing goes to its siblings first: an inner node's capacity is the sum of its
leaves', so only what a whole subtree can't take reaches other branches. Shares round down; the
tokens left over go one each to the first children by name that aren't full.

A leaf with budget b and t tokens takes b div t whole epochs, then a prefix of the next
epoch: ids in the order of md5(seed:epoch:id), up to the one that reaches the budget. The prefix's
end is found from totals per bucket of the digest and a window inside one bucket per leaf, so no
leaf is gathered whole; choosing documents is then a filter, and texts aren't shuffled.

A document's tokens are (bytes of its text + 3) div 4 unless a column is named. Null text: 0 tokens; null
lang or source: the empty string; null id: the empty string in the digest. Rows with one id
in a leaf are taken or left together. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

LEVELS = ("domain", "lang", "source")
#: A table of leaves up to this many rows is broadcast; a larger one is joined by key.
BROADCAST_LEAVES = 50_000
#: Documents that a bucket of a leaf's digests has on average, at most 16 ** 5 buckets.
BUCKET_DOCS = 1000


def domain_of(source: Column) -> Column:
    """The default domain: by the last digit of the source's name."""
    digit = F.regexp_extract(source, "([0-9])$", 1)
    return F.when(digit == "", "other").otherwise(F.concat(F.lit("domain"), (digit.try_cast("int") % 4).cast("string")))


@dataclass
class Mix:
    """share: of all tokens, the budget. weights: by level and name, whole numbers; others 1."""

    share: tuple[int, int] = (4, 5)
    max_epochs: int = 2
    seed: str = "mix"
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"domain0": 4, "domain1": 3, "domain2": 2}, "lang": {"en": 5, "de": 2, "fr": 2}})


def _weight(mix: Mix, level: str) -> Column:
    w = F.lit(1).cast("long")
    for name, x in mix.weights.get(level, {}).items():
        w = F.when(F.col(level) == name, F.lit(x).cast("long")).otherwise(w)
    return w


def _share_out(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """nodes (parent columns, level, w, cap, above: the parent's budget) with budget; whole numbers throughout."""
    p = Window.partitionBy(*parent)
    order = p.orderBy((F.col("cap") / F.col("w")), level)
    before, last = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    n = nodes.withColumns({"rest": F.col("above") - F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("w").over(last)})
    n = n.withColumn("full", F.col("cap") * F.col("open") <= F.col("w") * F.col("rest"))
    left = F.col("above") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(p), F.lit(0))
    n = n.withColumns({"left": left, "open": F.sum(F.when(~F.col("full"), F.col("w"))).over(p)})
    n = n.withColumn("floor", F.when(~F.col("full"), F.expr("(w * left) div open")))
    n = n.withColumn("odd", F.col("left") - F.sum("floor").over(p))
    turn = F.sum(F.when(~F.col("full"), 1).otherwise(0)).over(p.orderBy(level))
    got = F.when(F.col("full"), F.col("cap")).otherwise(F.col("floor") + F.when(turn <= F.col("odd"), 1).otherwise(0))
    return n.withColumn("budget", got).drop("rest", "open", "full", "left", "floor", "odd")


def _typed(documents: DataFrame, tokens: str | None, domain) -> DataFrame:
    t = F.col(tokens).cast("long") if tokens else F.expr("(octet_length(coalesce(text, '')) + 3) div 4")
    src = F.coalesce(F.col("source"), F.lit(""))
    return documents.withColumns({"_l": F.struct(domain(src).alias("domain"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), src.alias("source")), "_t": t})


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, lang, source, tokens) with budget. As many rows as there are sources, whatever the documents."""
    num, den = mix.share
    leaves = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    above = leaves.agg((F.least(F.expr(f"sum(tokens) * {num} div {den}"), F.sum("cap"))).alias("above"))
    for i, level in enumerate(LEVELS):
        parent, here = list(LEVELS[:i]), list(LEVELS[: i + 1])
        nodes = leaves.groupBy(*here).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(mix, level))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(above))  # one row
        above = _share_out(nodes, parent, level).select(*here, F.col("budget").alias("above"))
    return leaves.join(above.withColumnRenamed("above", "budget"), list(LEVELS))


def cuts(documents: DataFrame, mix: Mix, tokens: str | None = None, domain=domain_of) -> DataFrame:
    """Per leaf: tokens, budget, epochs (whole ones) and cut, the last digest taken in the next epoch (null: none)."""
    d = _typed(documents, tokens, domain).select("doc_id", "_l.*", F.col("_t").alias("t"))
    leaves = saved(d.groupBy(*LEVELS).agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    most, n = leaves.agg(F.max("docs"), F.count(F.lit(1))).first()
    digits = max(1, min(5, math.ceil(math.log(max(most or 1, 1) / BUCKET_DOCS, 16)))) if most else 1
    b = leaf_budgets(leaves, mix)
    b = saved(b.withColumn("epochs", F.coalesce(F.expr("try_divide(budget - pmod(budget, nullif(tokens, 0)), tokens)").cast("long"), F.lit(0).cast("long"))).withColumn("need", F.col("budget") - F.col("epochs") * F.col("tokens")))
    small = F.broadcast(b) if n <= BROADCAST_LEAVES else b
    keyed = d.join(small.select(*LEVELS, "epochs", "need"), list(LEVELS)).where("need > 0").withColumn("key", _digest(mix))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, digits))
    totals = keyed.groupBy(*LEVELS, "need", "bucket").agg(F.sum("t").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    edge = totals.withColumn("upto", upto).where("upto >= need AND upto - t < need").select(*LEVELS, "bucket", (F.col("need") - F.col("upto") + F.col("t")).alias("short"))
    edge = F.broadcast(edge) if n <= BROADCAST_LEAVES else edge
    inside = keyed.join(edge, [*LEVELS, "bucket"]).groupBy(*LEVELS, "short", "key").agg(F.sum("t").alias("t"))
    w = Window.partitionBy(*LEVELS).orderBy("key")
    cut = inside.withColumn("upto", F.sum("t").over(w)).where("upto - t < short").groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    return saved(b.join(cut, list(LEVELS), "left").select(*LEVELS, "tokens", "budget", "epochs", "cut"))


def _digest(mix: Mix) -> Column:
    return F.md5(F.concat(F.lit(f"{mix.seed}:"), F.col("epochs").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def chosen(documents: DataFrame, mix: Mix, tokens: str | None = None, domain=domain_of) -> DataFrame:
    """documents' rows that are taken, with _l (leaf), _t (tokens), _n (times taken) and _b (the leaf's budget)."""
    c = cuts(documents, mix, tokens, domain)
    c = c.select(F.struct(*LEVELS).alias("_leaf"), F.col("budget").alias("_b"), F.col("epochs").alias("_e"), F.col("cut").alias("_c"))
    c = F.broadcast(c) if c.count() <= BROADCAST_LEAVES else c
    d = _typed(documents, tokens, domain).join(c, F.col("_l") == F.col("_leaf"))
    key = F.md5(F.concat(F.lit(f"{mix.seed}:"), F.col("_e").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return d.withColumn("_n", F.col("_e") + F.coalesce((key <= F.col("_c")).cast("long"), F.lit(0))).where("_n > 0")


def mixed(documents: DataFrame, mix: Mix) -> DataFrame:
    """documents' rows that are taken, as often as they are taken; the columns stay."""
    c = chosen(documents, mix)
    if mix.max_epochs > 1:
        c = c.withColumn("_again", F.explode(F.expr("sequence(1L, _n)")))
    return c.select(*documents.columns)


def mixture(documents: DataFrame, mix: Mix | None = None) -> DataFrame:
    c = chosen(documents.select("doc_id", "text", "lang", "source"), mix or Mix())
    return c.select("doc_id", "_l.*", F.col("_t").alias("tokens"), F.col("_n").alias("times"), F.col("_b").alias("leaf_budget"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def _level_sql(above: str, parent: list[str], level: str, weight: str) -> str:
    p = f"PARTITION BY {', '.join(parent)}" if parent else ""
    here = ", ".join([*parent, level])
    join = f"JOIN {above} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above}"
    return f"""
    n_{level} AS (SELECT {here}, sum(cap)::BIGINT AS cap, {weight}::BIGINT AS w FROM leaves GROUP BY {here}),
    a_{level} AS (SELECT *, above - coalesce(sum(cap) OVER ({p} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER ({p} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM n_{level} {join}),
    f_{level} AS (SELECT *, cap * open <= w * rest AS filled FROM a_{level}),
    r_{level} AS (SELECT *, above - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({p}), 0) AS remaining, sum(CASE WHEN NOT filled THEN w END) OVER ({p}) AS open2 FROM f_{level}),
    s_{level} AS (SELECT *, CASE WHEN NOT filled THEN (w * remaining) // open2 END AS fl FROM r_{level}),
    b_{level} AS (SELECT {here}, CASE WHEN filled THEN cap ELSE fl + CASE WHEN sum(CASE WHEN filled THEN 0 ELSE 1 END) OVER ({p} ORDER BY {level}) <= remaining - sum(fl) OVER ({p}) THEN 1 ELSE 0 END END AS above FROM s_{level})"""


def _case(column: str, names: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in names.items()) + " ELSE 1 END"


def oracle(mix: Mix | None = None) -> str:
    mix = mix or Mix()
    levels = ",".join(_level_sql(f"b_{LEVELS[i - 1]}" if i else "total", list(LEVELS[:i]), x, _case(x, mix.weights[x]) if x in mix.weights else "1") for i, x in enumerate(LEVELS))
    return f"""
    WITH d AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9])$', 1) = '' THEN 'other' ELSE 'domain' || (regexp_extract(source, '([0-9])$', 1)::INT % 4)::VARCHAR END AS domain,
        coalesce(lang, '') AS lang, coalesce(source, '') AS source, ((strlen(coalesce(text, '')) + 3) // 4)::BIGINT AS t FROM documents),
    leaves AS (SELECT domain, lang, source, sum(t)::BIGINT AS tokens, sum(t)::BIGINT * {mix.max_epochs} AS cap FROM d GROUP BY ALL),
    total AS (SELECT least((sum(tokens) * {mix.share[0]}) // {mix.share[1]}, sum(cap)) AS above FROM leaves),{levels},
    e AS (SELECT domain, lang, source, above AS budget, CASE WHEN tokens = 0 THEN 0 ELSE above // tokens END AS epochs, CASE WHEN tokens = 0 THEN above ELSE above % tokens END AS need FROM leaves JOIN b_source USING (domain, lang, source)),
    k AS (SELECT *, md5('{mix.seed}:' || epochs::BIGINT::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM d JOIN e USING (domain, lang, source)),
    g AS (SELECT domain, lang, source, key, sum(t) AS t, sum(sum(t)) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM k GROUP BY domain, lang, source, key)
    SELECT doc_id, domain, lang, source, k.t AS tokens, (epochs + CASE WHEN upto - g.t < need THEN 1 ELSE 0 END)::BIGINT AS times, budget::BIGINT AS leaf_budget
    FROM k JOIN g USING (domain, lang, source, key) WHERE epochs + CASE WHEN upto - g.t < need THEN 1 ELSE 0 END > 0"""
