"""Functions called from SQL against the same columns, ingest days, and empty or short series."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns, sql
from tidemark.operators import distribution, scores
from tidemark.sources import tables


def test_functions_in_sql_are_the_columns(spark):
    assert set(sql.register(spark)) >= {"clipped", "normal_cdf", "t5_cdf", "interpolated", "probability_below", "re_anchored", "fan"}
    rng = random.Random(1)
    rows = [(rng.uniform(-8, 8), sorted(rng.uniform(-5, 5) for _ in range(19))) for _ in range(200)] + [(0.0, [float(i) for i in range(19)]), (None, [0.0] * 19), (3.0, [3.0] * 19)]
    df = spark.createDataFrame(rows, "x double, xs array<double>")
    ours = df.select(columns.normal_cdf(F.col("x")), columns.t5_cdf(F.col("x")), columns.clip(F.col("x"), -1, 2), columns.interpolate(F.col("x"), F.col("xs"), distribution.grid())).collect()
    theirs = spark.sql("SELECT normal_cdf(x), t5_cdf(x), clipped(x, -1D, 2D), probability_below(x, xs) FROM {df}", df=df).collect()
    for a, b in zip(ours, theirs):
        assert list(b) == [None if v is None else pytest.approx(v, abs=1e-12) for v in a]


def test_fan_in_sql_is_the_fan(spark):
    sql.register(spark)
    leaf = spark.createDataFrame([("a", 100.0, 0.1, 0.2, [k / 10 - 0.9 for k in range(19)]), ("b", 7.0, -0.1, 0.0, [0.0] * 19)], "index_id string, p0 double, mu double, sigma double, z array<double>")
    want = {(r.index_id, r.step): [r[n] for n in distribution.FAN] for r in distribution.fan(leaf, 6).collect()}
    got = {(r.index_id, r.step): [r[n] for n in distribution.FAN] for r in spark.sql("SELECT x.index_id, f.* FROM {leaf} AS x, LATERAL fan(x.p0, x.mu, x.sigma, x.z, 6) AS f", leaf=leaf).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_a_day_run_again_and_a_late_day(spark, tmp_path):
    at = str(tmp_path / "days")
    day = lambda rows: spark.createDataFrame(rows, "k long, v double, ingest_date string").withColumn("ingest_date", F.col("ingest_date").cast("date"))
    tables.write_days(day([(1, 1.0, "2020-01-01"), (2, 2.0, "2020-01-01"), (1, 3.0, "2020-01-02")]), at)
    for _ in range(2):
        tables.write_days(day([(1, 1.5, "2020-01-01")]), at)
    tables.write_days(day([(9, 9.0, "2019-12-31")]), at)
    read = lambda **how: sorted((r.k, r.v, str(r.ingest_date)) for r in tables.read_days(spark, at, **how).select("k", "v", "ingest_date").collect())
    assert read() == [(1, 1.5, "2020-01-01"), (1, 3.0, "2020-01-02"), (9, 9.0, "2019-12-31")]
    assert read(upto="2020-01-01") == [(1, 1.5, "2020-01-01"), (9, 9.0, "2019-12-31")] and read(only="2019-12-31") == [(9, 9.0, "2019-12-31")]
    last = tables.as_ingested(tables.read_days(spark, at), ["k"]).collect()
    assert sorted((r.k, r.v) for r in last) == [(1, 3.0), (9, 9.0)]
    plan = tables.read_days(spark, at, only="2019-12-31")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in plan


@pytest.mark.parametrize("rows", [0, 1, 23])
def test_short_and_empty_series(spark, rows):
    """Too few rows give no score, and never a failure."""
    f = spark.range(rows).select(F.lit("x").alias("index_id"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").alias("pos"), F.lit("m").alias("model"), F.lit(0.0).alias("fc"), F.lit(0.0).alias("realized"), F.lit(0.0).alias("bench"))
    assert scores.point_leaderboard(f, 12, 1950).count() == 0
    flat = f.withColumns({"policy": F.lit("p"), "fc_rw_drift": F.col("bench")})
    m = scores.policy_metrics(flat).collect()
    assert len(m) == (rows > 0) and all(r.r2_zero is None and r.r2_drift is None for r in m)
    assert scores.hac(f, F.lit(1.0), F.col("realized"), ["index_id"], "pos").where("t IS NOT NULL").count() == 0
    q = f.withColumns({"quant": F.array(*[F.lit(0.0)] * 19), "pit": F.lit(0.5)})
    assert scores.calibration(q, ["index_id"]).count() == scores.calibration_by_window(q.withColumn("all", F.lit(True)), ["index_id"], "all").where("window = 'own'").count() == (rows > 0)


def test_history_checks_name_all_that_fail(spark):
    rows = [(f"2000-{m:02d}-28", float(m)) for m in range(1, 13) if m != 7]
    df = spark.createDataFrame(rows, "d string, v double").withColumn("d", F.col("d").cast("date"))
    checks = tables.history_checks("d", "v", "2000-01-28", {"2000-03-31": (2.9, 3.1), "2000-05-31": (6.0, 7.0), "2000-07-31": (0.0, 99.0)}, 1999)
    got = {r.name: r.ok for r in tables.checked(df, checks).collect()}
    assert got == {"no month missing": False, "first day": True, "value of 2000-03": True, "value of 2000-05": False, "value of 2000-07": False, "starts by 1999": False}
    with pytest.raises(ValueError, match="no month missing; starts by 1999; value of 2000-05; value of 2000-07"):
        tables.require_all(tables.checked(df, checks))
    whole = df.unionByName(spark.sql("SELECT DATE '2000-07-01' AS d, 7D AS v"))
    good = {k: c for k, c in checks.items() if k not in ("value of 2000-05", "starts by 1999")}
    assert tables.require_all(tables.checked(whole, good)).count() == 4
    assert {r.ok for r in tables.checked(df.limit(0), checks).collect()} == {False}


def test_common_horizon_and_variants(spark):
    from tidemark.operators import document

    leaves = spark.createDataFrame([("a", "3mo"), ("a", "12mo"), ("a", "36mo"), ("b", "3mo"), ("b", "12mo")], "index_id string, horizon string")
    asked = spark.createDataFrame([("3mo",), ("36mo",), ("9mo",)], "asked string")
    assert {(r.asked, r.horizon) for r in document.common_horizon(leaves, asked).collect()} == {("3mo", "3mo"), ("36mo", "12mo"), ("9mo", "12mo")}
    v = spark.createDataFrame([(True, "long-run"), (False, "long-run"), (False, "core"), (None, "core")], "n boolean, tier string").select(document.variant(F.col("n"), F.col("tier")).alias("v")).collect()
    assert [r.v for r in v] == ["neutral", "long-run", "plain", "plain"]
