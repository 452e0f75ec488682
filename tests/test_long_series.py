"""Blocks of positions against windows over whole series, and exact order statistics against plain ones."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.test_operators import panel
from tidemark.operators import blocks, distribution, order, series, walk
from tidemark.operators import features as feat
from tidemark.operators.walk import YEAR


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=60), st.randoms())
def test_wavelet_against_sorted_slices(values, random):
    w, n = order.Wavelet(np.array(values), 5), len(values)
    spans = [sorted(random.choices(range(n + 1), k=2)) for _ in range(20)]
    spans = [(a, b) for a, b in spans if a < b] or [(0, n)]
    lo, hi = np.array(spans).T
    k = np.array([random.randrange(b - a) for a, b in spans])
    x = np.array([random.randrange(34) for _ in spans])
    got, place = w.kth(lo, hi, k)
    for i, (a, b) in enumerate(spans):
        s = sorted(values[a:b])
        assert got[i] == s[k[i]] and place[i] == k[i] - s.index(s[k[i]])
        assert w.below(lo[i : i + 1], hi[i : i + 1], x[i : i + 1])[0] == sum(v < x[i] for v in s)
    more = [random.randrange(4) for _ in range(32)]
    total = np.concatenate([[0], np.cumsum(more)])
    k = np.array([random.randrange(b - a + total[-1]) for a, b in spans])
    got, _ = w.kth(lo, hi, k, total)
    for i, (a, b) in enumerate(spans):
        assert got[i] == sorted(values[a:b] + [v for v, c in enumerate(more) for _ in range(c)])[k[i]]


def frame(spark, n=400, seed=3):
    """Two series with ties, missing values and missing questions, the second one short; extra columns go along."""
    rng = np.random.default_rng(seed)
    rows = []
    for index_id, size in (("a", n), ("b", 7)):
        v = np.round(rng.normal(size=size), 1)
        x = np.round(rng.normal(size=size), 1)
        rows += [(index_id, "m", i, None if rng.random() < 0.15 else float(v[i]), None if rng.random() < 0.1 else float(x[i]), [i]) for i in range(size)]
    return spark.createDataFrame(rows, "index_id string, model string, opos long, v double, x double, carried array<long>").repartition(5)


@pytest.mark.parametrize("size", [None, 20, 64, 1000])
def test_expanding_statistics(spark, size):
    got = order.expanding(frame(spark), {"s": ("v", "x"), "t": ("x", "v")}, 12, ("index_id", "model"), blocks=size).collect()
    assert len(got) == 407
    for index_id in "ab":
        own = sorted((r for r in got if r.index_id == index_id), key=lambda r: r.opos)
        for name, value, x in (("s", "v", "x"), ("t", "x", "v")):
            for i, r in enumerate(own):
                pool = [q[value] for q in own[: max(0, i - 11)] if q[value] is not None]
                assert r[f"{name}_n"] == len(pool) and r.carried == [i]
                if not pool:
                    assert r[f"{name}_q"] is None and r[f"{name}_below"] is None
                    continue
                np.testing.assert_allclose(r[f"{name}_q"], np.quantile(pool, np.arange(1, 20) / 20), atol=1e-12)
                assert r[f"{name}_below"] == (None if r[x] is None else pytest.approx(np.mean(np.array(pool) <= r[x])))


@pytest.mark.parametrize("size", [30, 1000])
def test_sliding_statistics(spark, size):
    rows = frame(spark).withColumn("v", F.coalesce("v", F.when(F.col("opos") != 150, F.lit(0.5))))
    got = order.sliding(rows, "v", 25, (0.5, 0.05), ("index_id", "model"), "opos", size).collect()
    assert len(got) == 407
    own = sorted((r for r in got if r.index_id == "a"), key=lambda r: r.opos)
    for i, r in enumerate(own):
        last = [q.v for q in own[max(0, i - 24) : i + 1]]
        if len(last) < 25 or None in last:
            assert r["_q"] is None and r["_below"] is None
        else:
            np.testing.assert_allclose(r["_q"], np.quantile(last, [0.5, 0.05]))
            assert r["_below"] == pytest.approx(np.mean(np.array(last[:-1]) < last[-1]))
    assert all(r["_q"] is None for r in got if r.index_id == "b")


def test_empty_tables(spark):
    none = frame(spark).limit(0)
    assert order.expanding(none, {"s": ("v", "x")}, 12, ("index_id", "model")).count() == 0
    assert order.expanding(none, {"s": ("v", "x")}, 12, ("index_id", "model"), blocks=50).count() == 0
    assert order.sliding(none, "v", 5, (0.5,), ("index_id", "model"), "opos").count() == 0
    assert blocks.placed(none, ["opos"]).count() == 0


def test_places_are_those_of_one_sort(spark):
    df = frame(spark).select("index_id", F.col("opos").alias("date"), "v")
    a, b = ({(r.index_id, r.date): r.pos for r in f(df).collect()} for f in (series.positioned, lambda x: blocks.placed(x)))
    assert a == b and len(a) == 407


def close(a, b, by):
    a, b = (x.toPandas().sort_values(by).reset_index(drop=True) for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b) and len(a)
    for c in a.columns:
        if c == "quant":
            for x, y in zip(a[c], b[c]):
                assert (x is None) == (y is None) and (x is None or np.allclose(x, y, rtol=1e-9))
        elif a[c].dtype == float:
            np.testing.assert_allclose(a[c].to_numpy(), b[c].to_numpy(), rtol=1e-8, atol=1e-10)
        else:
            assert (a[c] == b[c]).all()


@pytest.fixture(scope="module")
def long(spark):
    both = panel(spark, 1100).unionByName(panel(spark, 900, 5, "y"))
    return feat.valuation_features(feat.with_valuation(both)).cache()


def test_features_in_blocks(spark, long):
    again = feat.valuation_features(feat.with_valuation(panel(spark, 1100).unionByName(panel(spark, 900, 5, "y"))), blocks=400)
    close(again, long, ["index_id", "pos"])
    close(feat.rolling_trend(long, blocks=300), feat.rolling_trend(long), ["index_id", "pos"])


@pytest.mark.parametrize("lag", [0, 3])
def test_walk_in_blocks_is_the_walk(long, lag):
    x = {"cape": F.col("log_cape"), "gap": F.col("gap")}
    close(walk.walk(long, YEAR, lag, predictors=x, blocks=50), walk.walk(long, YEAR, lag, predictors=x), ["index_id", "pos"])
    close(walk.expanding_lambda(long, YEAR, lag, 64), walk.expanding_lambda(long, YEAR, lag), ["index_id", "pos"])
    close(walk.predictive_regressions(long, x, blocks=40), walk.predictive_regressions(long, x), ["index_id", "pos"])


def test_calibration_in_blocks(spark, long):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame(pd.DataFrame({"index_id": np.repeat(["x", "y"], 1100), "pos": np.tile(np.arange(1100), 2), "model": "m", "v": np.where(rng.random(2200) < 0.1, np.nan, rng.uniform(0.001, 0.01, 2200))}))
    v = v.withColumn("v", F.when(~F.isnan("v"), F.col("v"))).where("NOT (index_id = 'y' AND pos >= 900)")
    rows = distribution.residuals(walk.walk(long), v, YEAR).cache()
    one, many = distribution.level_calibrated(rows, YEAR), distribution.level_calibrated(rows, YEAR, 60)
    close(many, one, ["index_id", "opos"])
    close(distribution.simulated(many, YEAR, 60), distribution.simulated(one, YEAR), ["index_id", "opos"])
    close(distribution.historical(many, YEAR, 60), distribution.historical(one, YEAR), ["index_id", "opos"])


def test_a_long_series_is_dealt_over_tasks(spark):
    """One series of 200,000 rows: every step runs in as many tasks as there are partitions."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(200_000).select(F.lit("x").alias("index_id"), F.col("id").alias("date"), F.sin("id").alias("v"))
        p = blocks.placed(df)
        s = order.sliding(p, "v", 360, (0.5,), blocks=8192)
        used = s.groupBy(F.spark_partition_id().alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(used) == 4 and max(r.n for r in used) < 120_000
        h = blocks.haloed(p.withColumn("ok", F.lit(1.0)), 8192, before=12)
        t = blocks.scanned(h, {"total": F.col("ok")}, 12, 8192)
        used = blocks.own(t).groupBy(F.spark_partition_id().alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.greatest(F.col("pos") - 11, F.lit(0)) - F.coalesce("total", F.lit(0)))).alias("wrong")).collect()
        assert len(used) == 4 and all(r.wrong == 0 for r in used)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("make", [
    lambda f: walk.walk(f, YEAR, 3, blocks=50),
    lambda f: walk.predictive_regressions(f, {"cape": F.col("log_cape"), "gap": F.col("gap")}, blocks=40),
    lambda f: blocks.placed(f.drop("pos")),
], ids=["walk", "regressions", "places"])
def test_rows_are_not_dealt_again_for_totals(spark, long, make):
    """Totals, means and places of blocks come to the rows, however large Spark takes them to be; else all rows of a series meet in one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = make(long)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def records_dealt(df):
    """Rows that the exchanges of a plan write, each exchange once."""
    plan, n = df._jdf.queryExecution().executedPlan(), 0
    df._jdf.queryExecution().toRdd().count()
    todo = [plan]
    while todo:
        p = todo.pop()
        n += p.metrics().apply("shuffleRecordsWritten").value() if p.metrics().contains("shuffleRecordsWritten") else 0
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return n


@pytest.mark.parametrize("places", [1, 9])
def test_quantiles_of_a_row_are_not_dealt_one_by_one(spark, places):
    """Neighbouring rows share what they ask of a bucket: a row's 19 quantiles and its rank are few rows, for distinct values and for many equal ones; and they are right."""
    rng = np.random.default_rng(7)
    v = np.round(rng.normal(size=16_000), places)
    rows = spark.createDataFrame(pd.DataFrame({"index_id": "a", "opos": np.arange(len(v)), "v": v})).repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = order.expanding(rows, {"s": ("v", "v")}, 12, ("index_id",), blocks=1000)
        assert records_dealt(got) < 10 * len(v)
        got = got.where("opos % 997 = 0 OR opos < 40").toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(got) == 56
    for r in got.itertuples():
        pool = v[: max(0, r.opos - 11)]
        assert r.s_n == len(pool)
        if len(pool):
            np.testing.assert_allclose(r.s_q, np.quantile(pool, np.arange(1, 20) / 20), atol=1e-12)
            assert r.s_below == pytest.approx(np.mean(pool <= r.v))
