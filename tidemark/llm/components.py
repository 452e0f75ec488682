"""Connected components of a graph whose nodes have a bounded number of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Links that a part holds about; the rounds' tables have no more parts than they need, so that small graphs make few files.
PART_LINKS = 250_000


#: Parts that the rows of one key are joined in.
SALTS = 8


def salted(rows: DataFrame, few: DataFrame, on: str, by: str) -> DataFrame:
    """rows joined by `on` with few, which has a key once: rows of one key are dealt by `by` over SALTS parts, each with a copy of few's row."""
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [on, "_salt"]).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> (node, root): root is the smallest node reachable; only nodes with links are returned.

    Every round a node takes the least label among itself and its neighbours, then the label of its label, so
    rounds grow with the logarithm of a component's diameter. The links stay as they came: no node gathers more
    of them than it had. Rounds are saved in the shared folder.
    """
    both = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    parts = max(1, -(-both.count() // PART_LINKS))
    both = both.coalesce(parts)
    now = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")).coalesce(parts))
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = now.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
        now = saved(salted(step, up, "root", "node").select("node", F.least("root", "further").alias("root"), "old").coalesce(parts))
        if now.where("root <> old").isEmpty():
            return now.select("node", "root")
        now = now.select("node", "root")
