"""Joins by time against plain loops, with ties, gaps of many buckets, nulls and columns of the same names."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import as_of, known_at, latest_known

DAY = dt.datetime(2000, 1, 1)


def sides(spark, n=300, seed=1):
    rng = random.Random(seed)
    left = [(i, rng.choice("xy"), DAY + dt.timedelta(hours=rng.randrange(0, 24 * 400)) if rng.random() > 0.05 else None) for i in range(n)] + [(n, "z", DAY)]
    right = [(i, rng.choice("xy"), DAY + dt.timedelta(hours=12 * rng.choice([rng.randrange(0, 60), rng.randrange(600, 780)])) if rng.random() > 0.05 else None) for i in range(150)]
    right += [(900 + i, "x", left[7][2] or DAY) for i in range(3)]
    schema = "id long, kind string, at timestamp"
    return left, right, spark.createDataFrame(left, schema).repartition(4), spark.createDataFrame(right, schema).repartition(3)


@pytest.mark.parametrize("how", ["before", "after", "nearest"])
def test_as_of_matches_a_plain_search(spark, how):
    left, right, a, b = sides(spark)
    got = {r.id: r for r in as_of(a, b, "at", "at", ["kind"], "id", how).collect()}
    assert len(got) == len(left)
    for i, kind, at in left:
        own = [(t, k) for k, x, t in right if x == kind and t is not None and at is not None and (how == "nearest" or (t <= at if how == "before" else t >= at))]
        if how == "before":
            best = min(own, key=lambda x: (at - x[0], x[1]), default=None)
        elif how == "after":
            best = min(own, key=lambda x: (x[0] - at, x[1]), default=None)
        else:
            best = min(own, key=lambda x: (abs(x[0] - at), x[0], x[1]), default=None)
        r = got[i]
        assert (r.kind, r.at) == (kind, at)
        assert (r["_right"].id if r["_right"] else None) == (best[1] if best else None), (i, kind, at)


def test_as_of_with_empty_sides(spark):
    _, _, a, b = sides(spark)
    assert as_of(a, b.limit(0), "at", "at", ["kind"], "id").where("_right IS NOT NULL").count() == 0
    assert as_of(a, b.limit(0), "at", "at", ["kind"], "id", "nearest").count() == a.count()
    assert as_of(a.limit(0), b, "at", "at", ["kind"], "id").count() == 0


def test_later_versions_change_later_moments_only(spark):
    d = lambda m, k=1: dt.date(2000, m, k)
    versions = [("a", d(1), d(2), 1.0), ("a", d(1), d(3), 2.0), ("a", d(1), d(3), 1.5), ("a", d(2), d(3, 15), 5.0), ("a", d(2), None, 9.0), ("a", d(3), d(4), None), ("b", d(1), d(6), 7.0)]
    moments = [(d(1),), (d(2),), (d(3),), (d(5),), (d(7),), (d(7),), (None,)]

    def known(rows):
        v = spark.createDataFrame(rows, "series string, period date, published date, value double")
        m = spark.createDataFrame(moments, "seen date")
        return known_at(v, m, ["series"], "period", "published", "seen", ["value"])

    got = {(r.series, r.period, r.seen): r.value for r in known(versions).collect()}
    assert got == {
        ("a", d(1), d(2)): 1.0, ("a", d(1), d(3)): 2.0, ("a", d(1), d(5)): 2.0, ("a", d(1), d(7)): 2.0, ("a", d(2), d(5)): 5.0, ("a", d(2), d(7)): 5.0,
        ("a", d(3), d(5)): None, ("a", d(3), d(7)): None, ("b", d(1), d(7)): 7.0,
    }
    more = {(r.series, r.period, r.seen): r.value for r in known([*versions, ("a", d(1), d(4, 20), 8.0)]).collect()}
    assert {k for k in got if got[k] != more[k]} == {("a", d(1), d(5)), ("a", d(1), d(7))}
    last = {(r.series, r.seen): (r.period, r.value) for r in latest_known(known(versions), ["series"], "period", "seen", "value").collect()}
    assert last[("a", d(5))] == (d(2), 5.0) and last[("a", d(2))] == (d(1), 1.0) and ("b", d(5)) not in last


def test_a_hot_key_is_dealt_over_its_buckets(spark):
    """One key of 50,000 rows over ten years: no task has more than a share of them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(50_000).select(F.lit("x").alias("kind"), F.timestamp_seconds(F.col("id") * 6300).alias("at"), "id")
        j = as_of(rows, rows.where("id % 50 = 3"), "at", "at", ["kind"], "id")
        parts = j.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("id") - F.col("_right.id"))).alias("far")).collect()
        assert sum(r.n for r in parts) == 50_000 and max(r.n for r in parts) < 30_000 and max(r.far or 0 for r in parts) == 49
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
