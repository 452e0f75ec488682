"""Joins by time: the row before, after or nearest to a moment, and what was known of a moment at another one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _edges(rows: DataFrame, keys: Sequence[str], value: str, forward: bool) -> DataFrame:
    """rows with `value` filled from the last row (forward: before, in the order of _t and _side) that has one, in the bucket and all earlier ones.

    Inside a bucket by a window; a bucket's own last value goes to the later buckets by a window over buckets, a row each.
    """
    order = [F.col("_t"), F.col("_side")] if forward else [F.desc("_t"), F.desc("_side")]
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.max_by if forward else F.min_by
    edge = rows.where(F.col(value).isNotNull()).groupBy(*keys, "_bucket").agg(pick(value, F.struct("_t", "_side")).alias("_e"))
    marks = rows.select(*keys, "_bucket").distinct().join(edge, [*keys, "_bucket"], "left")
    across = Window.partitionBy(*keys).orderBy("_bucket" if forward else F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*keys, "_bucket", F.last("_e", ignorenulls=True).over(across).alias("_c"))
    filled = rows.withColumn("_f", F.last(value, ignorenulls=True).over(inside))
    return filled.join(carried, [*keys, "_bucket"]).withColumn(value, F.coalesce("_f", "_c")).drop("_f", "_c")


def as_of(left: DataFrame, right: DataFrame, time: str, right_time: str, keys: Sequence[str], tie: str, how: str = "before", bucket: str = "month") -> DataFrame:
    """left with _right, a struct of the right row of its keys that is last at or before its time ("before"), first at or after it ("after"), or
    nearest ("nearest": the earlier of two as near); null if there is none. tie: of right rows at one time, the least by this column counts.

    Both sides lie in one sorted order by keys and bucket of time, so a key of any size is dealt over its buckets, and edges are
    carried between buckets; nothing is joined row by row. Key columns must have no null; left rows without a time get null.
    """
    if how not in ("before", "after", "nearest"):
        raise ValueError(how)
    at_left, at_right = F.col(time).cast("timestamp"), F.col(right_time).cast("timestamp")
    one = Window.partitionBy(*keys, right_time).orderBy(tie)
    r = right.where(F.col(right_time).isNotNull()).withColumn("_i", F.row_number().over(one)).where("_i = 1").drop("_i")
    r = r.select(*keys, at_right.alias("_t"), F.struct(at_right.alias("_at"), F.struct(*right.columns).alias("row")).alias("_right"))
    # At one time the right row comes before the left one looking back, and after it looking ahead.
    rows = left.where(F.col(time).isNotNull()).select(*keys, at_left.alias("_t"), F.struct(*left.columns).alias("_left"))

    def side(forward: bool) -> DataFrame:
        both = rows.withColumns({"_right": F.lit(None), "_side": F.lit(1 if forward else 0)}).unionByName(r.withColumns({"_left": F.lit(None), "_side": F.lit(0 if forward else 1)}))
        return _edges(both.withColumn("_bucket", F.date_trunc(bucket, "_t")), keys, "_right", forward).where("_left IS NOT NULL")

    if how != "nearest":
        out = side(how == "before").select("_left", F.col("_right.row").alias("_right"))
    else:  # what lies before goes along as a column while the other direction is filled
        back = side(True).select(*keys, "_t", F.struct(F.col("_left").alias("l"), F.col("_right").alias("r")).alias("_left"))
        rows = back
        ahead = side(False)
        before, after = F.col("_left.r"), F.col("_right")
        gap = lambda x: F.abs(F.unix_micros(x["_at"]) - F.unix_micros(F.col("_t")))
        near = F.when(after.isNull() | (gap(before) <= gap(after)), before["row"]).otherwise(after["row"])
        out = ahead.select(F.col("_left.l").alias("_left"), near.alias("_right"))
    out = out.select("_left.*", "_right")
    return out.unionByName(left.where(F.col(time).isNull()).withColumn("_right", F.lit(None).cast(out.schema["_right"].dataType)))


def known_at(versions: DataFrame, moments: DataFrame, keys: Sequence[str], period: str, published: str, moment: str, value: Sequence[str]) -> DataFrame:
    """For each moment, the values as they were known then: of every period the version published last by that moment.

    versions (keys, period, published, values...): several versions of a period, each from its day of publishing on, until the next one. moments: a short
    list of times, a row each, which Spark may broadcast; a version is copied only to the moments that it was in force at.
    """
    w = Window.partitionBy(*keys, period).orderBy(published)
    last = F.row_number().over(Window.partitionBy(*keys, period, published).orderBy(*[F.desc(v) for v in value]))
    v = versions.where(F.col(published).isNotNull()).withColumn("_n", last).where("_n = 1").withColumn("_until", F.lead(published).over(w))
    m = moments.select(F.col(moment).alias("_s")).where("_s IS NOT NULL").distinct().agg(F.sort_array(F.collect_set("_s")).alias("_all"))
    hits = F.filter("_all", lambda s: (s >= F.col(published)) & (F.col("_until").isNull() | (s < F.col("_until"))))
    v = v.crossJoin(F.broadcast(m)).withColumn(moment, F.explode(hits))  # one row
    return v.select(*keys, period, moment, published, *value)


def latest_known(known: DataFrame, keys: Sequence[str], period: str, moment: str, value: str, valid_at: Column | None = None) -> DataFrame:
    """Of known_at(): per keys and moment the last period that isn't after the moment (or a date of its own), and its value."""
    inside = F.col(period) <= (F.col(moment) if valid_at is None else valid_at)
    return known.where(inside & F.col(value).isNotNull()).groupBy(*keys, moment).agg(F.max(period).alias(period), F.max_by(value, period).alias(value))
