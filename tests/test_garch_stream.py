"""The GARCH stream equals the batch recursion after any cut into batches, and after a restart; it asks for parameters in time."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import volatility
from tidemark.streaming.garch import TICKS, folded_garch, garch_stream, stateful
from tidemark.streaming.live import finished


def made(n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for name, at in (("a", 0), ("b", 10)):
        rows += [(name, at + i, None if rng.random() < 0.1 else float(rng.normal(0, 0.05)), None, None, None, None) for i in range(n)]
    return rows


FITS = [("a", 0, 0.0001, 0.1, 0.8, 0.002), ("b", 10, 0.0002, 0.05, 0.9, 0.001)]
NEW = ("a", 33, None, 0.0003, 0.2, 0.6, 0.004)


def landed(spark, tmp_path, rows, cuts):
    """A file per batch, in order of time."""
    import os

    parts = np.split(np.arange(len(rows)), cuts)
    for i, part in enumerate(parts):
        pdf = spark.createDataFrame([rows[k] for k in part], TICKS).coalesce(1)
        pdf.write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("part-*"):
            os.utime(f, (1e9 + i, 1e9 + i)) if f.stat().st_mtime > 1e9 + 100 else None


@pytest.mark.parametrize("cuts", [[], [7, 20, 21, 90], [1, 2, 3, 50, 110]])
def test_any_cut_gives_the_batch_recursion(spark, tmp_path, cuts):
    rows = sorted([*made(), NEW], key=lambda r: (r[1], r[3] is None, r[0]))
    landed(spark, tmp_path, rows, cuts)
    stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fits = spark.createDataFrame(FITS, "index_id string, at long, omega double, alpha double, beta double, last double")
    with stateful(spark):
        got = finished(garch_stream(stream, fits, refit=20), "update").collect()
    v = {(r.index_id, r.pos): r.v for r in got if not r.asks}
    for name, at, omega, alpha, beta, last in FITS:
        own = [r for r in rows if r[0] == name and r[3] is None]
        r = np.array([np.nan if x[2] is None else x[2] for x in own])
        cut = 33 if name == "a" else len(own)
        want = [*folded_garch(last, omega, alpha, beta, r[:cut]), *(folded_garch(NEW[6], *NEW[3:6], r[cut:]) if name == "a" else [])]
        assert [v[name, x[1]] for x in own] == pytest.approx(want, rel=1e-12)
    asked = {r.index_id for r in got if r.asks}
    assert not asked - {"a", "b"} and (len(cuts) == 0 or "b" in asked)


def test_restart_goes_on_where_it_was(spark, tmp_path):
    rows = [r for r in made(80, 2) if r[0] == "a"]
    fits = spark.createDataFrame(FITS[:1], "index_id string, at long, omega double, alpha double, beta double, last double")
    seen = {}

    def run(part):
        spark.createDataFrame(part, TICKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = garch_stream(spark.readStream.schema(TICKS).parquet(str(tmp_path / "in")), fits)
        with stateful(spark):
            q = s.writeStream.option("checkpointLocation", str(tmp_path / "state")).outputMode("update").trigger(availableNow=True).foreachBatch(lambda df, i: seen.update({r.pos: r.v for r in df.collect() if not r.asks})).start()
            q.awaitTermination()

    run(rows[:30])
    run(rows[30:])
    r = np.array([np.nan if x[2] is None else x[2] for x in rows])
    assert [seen[x[1]] for x in rows] == pytest.approx(list(folded_garch(FITS[0][5], *FITS[0][2:5], r)), rel=1e-12)


def test_stream_of_fits_and_returns_is_the_batch_operator(spark, tmp_path):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    returns = spark.createDataFrame(pd.DataFrame({"index_id": "x", "pos": np.arange(400), "r": rng.normal(0, 0.04, 400)}))
    fits = volatility.garch_fits(returns, 60).cache()
    want = {r.pos: r.v_garch for r in volatility.garch(returns, 60, fits).where("pos >= 240").collect()}
    null = F.lit(None).cast("double")
    ticks = returns.where("pos >= 240").select("index_id", "pos", "r", *[null.alias(c) for c in ("omega", "alpha", "beta", "last")])
    ticks = ticks.unionByName(fits.where("omega IS NOT NULL").select("index_id", F.col("at").alias("pos"), null.alias("r"), "omega", "alpha", "beta", "last"))
    ticks.orderBy("pos").coalesce(1).write.parquet(str(tmp_path / "in"))
    with stateful(spark):
        got = {r.pos: r.v for r in finished(garch_stream(spark.readStream.schema(TICKS).parquet(str(tmp_path / "in"))), "update").where("NOT asks").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
