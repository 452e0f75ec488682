"""Places and running totals in groups of any size, with no group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """df with pos (from 0 in its group, by order, nulls first), group_rows, and run_<x>, the total of x up to and with the row, for x in sums.

    Rows are range-sorted by groups and order, so a large group lies in several ranges. Each range counts its own part of a group;
    a window over these parts, at most one a range and group, says what came before. Null is a group of its own. Equal
    rows are ranked in any order, and are dealt over ranges too. df is read twice: keep it narrow.
    """
    dealt = df.withColumn("_deal", F.monotonically_increasing_id())
    by = [*groups, *order, "_deal"]
    rows = written(dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop("_deal").withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftrightunsigned("_at", 33))
    here = [*groups, "_part"]
    if sums:
        local = Window.partitionBy(*here).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({f"run_{x}": F.sum(x).over(local) for x in sums})
    parts = rows.groupBy(*here).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), *[F.max_by(f"run_{x}", "_at").alias(f"_t_{x}") for x in sums])
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    parts = parts.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_part").alias("_g_part"), (start("_n") - F.col("_first")).alias("_from"), F.sum("_n").over(whole).alias("group_rows"),
        *[start(f"_t_{x}").alias(f"_b_{x}") for x in sums],
    )
    same = F.col("_part") == F.col("_g_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = rows.join(parts, same).withColumns({"pos": F.col("_at") + F.col("_from"), **{f"run_{x}": F.col(f"run_{x}") + F.col(f"_b_{x}") for x in sums}})
    return out.select(*df.columns, "pos", "group_rows", *[f"run_{x}" for x in sums])
