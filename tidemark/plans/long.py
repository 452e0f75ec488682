"""Queries on series as long as a table: every order is a period, and a series is dealt over tasks in blocks of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distribution as dist
from ..operators import features as feat
from ..operators import walk
from ..operators.blocks import placed
from ..operators.walk import YEAR
from ..sources.tables import table
from .panel import GRID_SQL, SIDE, sql, walk_sql
from .registry import query
from .shown import picked, shown

#: Rows of a block at least, and blocks of a series at most, as a block's totals are scanned by blocks.
LEAST_ROWS, MOST_BLOCKS = 4096, 2048


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per order: main has all, side the urgent ones; sorted and kept once."""
    o = table(spark, sf_dir, "orders")
    index = F.explode(F.when(F.col("o_orderpriority") == SIDE, F.array(F.lit("main"), F.lit("side"))).otherwise(F.array(F.lit("main"))))
    e = 99_991 * (1 + F.col("o_custkey") % 7 / 10)
    t = o.select(index.alias("index_id"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("p"), (F.col("o_totalprice") / e).alias("cape"), (F.col("o_custkey") % 5).alias("kind"))
    return placed(t, ["date", "key"])


def block_rows(t: DataFrame) -> int:
    return max(LEAST_ROWS, -(-(t.agg(F.max("pos")).first()[0] or 0) // MOST_BLOCKS))


def long_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Features, for what reads them once, and the rows of a block."""
    t = ticks(spark, sf_dir)
    rows = block_rows(t)
    return feat.valuation_features(t, rows), rows


TICKS = f"""
tk AS (SELECT index_id, date, key, p, p / (99991 * (1 + c % 7 / 10.0::DOUBLE)) AS cape, c % 5 AS kind, row_number() OVER (PARTITION BY index_id ORDER BY date, key) - 1 AS pos
    FROM (SELECT unnest(CASE WHEN o_orderpriority = '{SIDE}' THEN ['main', 'side'] ELSE ['main'] END) AS index_id, o_orderdate::DATE AS date, o_orderkey AS key, o_totalprice AS p, o_custkey AS c FROM orders)),
tr AS MATERIALIZED (SELECT *, count(cape) OVER t = 360 AS filled, quantile_cont(cape, [0.5, 0.05, 0.25, 0.75, 0.95]) OVER t AS q, ln(p / cape) AS le, list(cape) OVER (PARTITION BY index_id ORDER BY pos ROWS BETWEEN 359 PRECEDING AND 1 PRECEDING) AS before
    FROM tk WINDOW t AS (PARTITION BY index_id ORDER BY pos ROWS BETWEEN 359 PRECEDING AND CURRENT ROW)),
ft AS MATERIALIZED (SELECT index_id, date, pos, p, cape, kind, ln(p) AS log_p, (le - lag(le, 240) OVER o) / 20 AS g, NULL::DOUBLE AS r, NULL::DOUBLE AS rate, NULL::DOUBLE AS spread,
    CASE WHEN filled THEN q[1] END AS cape_star, CASE WHEN filled THEN q[2] END AS q05, CASE WHEN filled THEN q[3] END AS q25, CASE WHEN filled THEN q[4] END AS q75, CASE WHEN filled THEN q[5] END AS q95,
    CASE WHEN filled THEN len(list_filter(before, lambda x: x < cape)) / 359.0 END AS pctile, CASE WHEN filled THEN ln(q[1]) - ln(cape) END AS gap FROM tr WINDOW o AS (PARTITION BY index_id ORDER BY pos))"""
_BANDS = "g cape_star q05 q25 q75 q95 pctile gap"


@query(sql(TICKS) + " SELECT " + picked("index_id", _BANDS, "pos") + " FROM ft")
def e04_long_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing median, bands and rank of every order among the 360 up to it."""
    return shown(long_features(spark, sf_dir)[0], f"index_id pos {_BANDS}")


_WALK = "realized lam_ols lam_used fc_level0_est fc_rw_drift band_q05 band_q95"


@query(sql(TICKS, walk_sql(lag=3)) + " SELECT " + picked("index_id", _WALK, "pos opos") + " FROM og")
def e07_long_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk-forward over every order, with signals held back by three, running totals carried from block to block."""
    f, rows = long_features(spark, sf_dir)
    return shown(walk.walk(f, YEAR, lag=3, blocks=rows), f"index_id pos opos {_WALK}")


_LINE = "CASE WHEN regr_count(fwd, {x}) OVER w >= 120 AND {x} IS NOT NULL THEN regr_intercept(fwd, {x}) OVER w + regr_slope(fwd, {x}) OVER w * {x} END"


@query(sql(TICKS, walk_sql()) + f", rg AS (SELECT index_id, pos, {_LINE.format(x='gap')} AS fc_gap, {_LINE.format(x='log_p')} AS fc_log_p FROM og_b WINDOW w AS (PARTITION BY index_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 12 PRECEDING)) SELECT " + picked("index_id", "fc_gap fc_log_p", "pos") + " FROM rg")
def e26_long_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes regressed on one predictor each, over all completed orders before each order."""
    f, rows = long_features(spark, sf_dir)
    return shown(walk.predictive_regressions(f, {"gap": F.col("gap"), "log_p": F.col("log_p")}, YEAR, blocks=rows), "index_id pos fc_gap fc_log_p")


def long_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's forecast with its deviation, quantiles and rank among all completed ones; null variances among them."""
    f, rows = long_features(spark, sf_dir)
    origins = walk.walk(f, YEAR, blocks=rows, keep=("kind",))
    v = F.when(F.col("kind") > 0, F.pow(0.4 + F.col("kind") / 10, F.lit(2.0)) / 12)
    r = origins.select("index_id", F.lit("kind").alias("model"), "opos", F.col("fc_level0_est").alias("mu"), "realized", (F.col("realized") - F.col("fc_level0_est")).alias("resid"), F.sqrt(YEAR.steps * v).alias("raw"))
    return dist.simulated(dist.level_calibrated(r, YEAR, rows), YEAR, rows)


@query(sql(TICKS, walk_sql(), f"""
ra AS MATERIALIZED (SELECT og.index_id, og.pos, opos, fc_level0_est AS mu, realized, realized - fc_level0_est AS resid, CASE WHEN kind > 0 THEN sqrt(12 * (pow(0.4 + kind / 10.0::DOUBLE, 2) / 12)) END AS raw FROM og JOIN tk USING (index_id, pos)),
rb AS (SELECT *, CASE WHEN raw IS NOT NULL AND count(mu) OVER w >= 120 AND count(raw) OVER w >= 120 THEN raw * sqrt(avg(CASE WHEN raw IS NOT NULL THEN resid * resid END) OVER w / avg(raw * raw) OVER w) END AS sigma
    FROM ra WINDOW w AS (PARTITION BY index_id ORDER BY opos ROWS BETWEEN UNBOUNDED PRECEDING AND 12 PRECEDING)),
rc AS MATERIALIZED (SELECT *, CASE WHEN sigma > 0 THEN resid / sigma END AS z FROM rb),
rd AS MATERIALIZED (SELECT *, count(z) OVER w AS n, quantile_cont(z, {GRID_SQL}) OVER w AS zq FROM rc WINDOW w AS (PARTITION BY index_id ORDER BY opos ROWS BETWEEN UNBOUNDED PRECEDING AND 12 PRECEDING)),
below AS (SELECT a.index_id, a.opos, count(b.z) AS k FROM rc a LEFT JOIN rc b ON b.index_id = a.index_id AND b.opos <= a.opos - 12 AND b.z <= a.z GROUP BY 1, 2)""")
    + " SELECT index_id, opos::BIGINT AS opos, round(sigma, 6) AS sigma, " + ", ".join(f"round(mu + sigma * zq[{i}], 6) AS {q}" for i, q in ((1, "q05"), (10, "q50"), (19, "q95"))) + ", round(k / n::DOUBLE, 6) AS pit FROM rd JOIN below USING (index_id, opos) WHERE sigma IS NOT NULL AND n >= 120")
def e20_long_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles and ranks over all completed orders, of every order, without any order carrying its past."""
    r = long_calibrated(spark, sf_dir).where("quant IS NOT NULL")
    r = r.withColumns({q: F.get("quant", F.lit(i)) for i, q in ((0, "q05"), (9, "q50"), (18, "q95"))})
    return shown(r, "index_id opos sigma q05 q50 q95 pit")
