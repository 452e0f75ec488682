"""Series made of the star schema's tables, and the SQL of the same.

A day is a period. Orders give prices, shipments earnings, dividends and a few macro series; the index
`main` has all orders, `side` the urgent ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distribution as dist
from ..operators import features as feat
from ..operators import volatility as vol
from ..operators.walk import YEAR, Horizon, walk
from ..sources.tables import kept, table

SIDE = "1-URGENT"
MACRO = ("rate", "spread", "level")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    index = F.explode(F.when(F.col("o_orderpriority") == SIDE, F.array(F.lit("main"), F.lit("side"))).otherwise(F.array(F.lit("main"))))
    o = o.select(index.alias("index_id"), F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice")
    x = F.col("o_totalprice")
    return o.groupBy("index_id", "date").agg(F.avg(x).alias("p"), F.max(x).alias("high"), F.min(x).alias("low"), F.max_by(x, "o_orderkey").alias("close"))


def day_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per day: main's prices, and p_side, the side's; one scan."""
    x, side = F.col("o_totalprice"), F.col("o_orderpriority") == SIDE
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date"))
    return o.agg(F.avg(x).alias("p"), F.max(x).alias("high"), F.min(x).alias("low"), F.max_by(x, "o_orderkey").alias("close"), F.avg(F.when(side, x)).alias("p_side"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    return x.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.avg(price * (1 - F.col("l_discount"))).alias("e"), F.avg(price * F.col("l_tax")).alias("d"),
        F.avg("l_discount").alias("rate"), F.avg("l_tax").alias("spread"), F.avg("l_quantity").alias("level"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with its anchors and returns: a row per series and period."""
    v = prices(spark, sf_dir).select("index_id", "date", "p").join(shipments(spark, sf_dir), "date")
    return vol.with_returns(feat.valuation_features(feat.with_valuation(v)))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """features(), kept: for queries that read it more than once, so that orders and lineitem are each scanned once."""
    return kept(features(spark, sf_dir))


ALL = ("const", "ewma", "garch", "vix")


def with_variances(f: DataFrame, names: tuple[str, ...] = ("const", "ewma", "vix")) -> DataFrame:
    """f with a column v_<name> for each name, in one pass over its series; those of GARCH are kept."""
    made = {"const": vol.constant, "ewma": vol.ewma, "garch": vol.garch, "vix": lambda r: vol.implied(r.withColumn("_level", F.col("rate") * 400), "_level").drop("_level")}
    for n in names:
        f = made[n](f)
    return kept(f) if "garch" in names else f


def variances(f: DataFrame, names: tuple[str, ...] = ("const", "ewma", "vix")) -> DataFrame:
    """index_id, pos, model, v."""
    return vol.unpivoted(f if set(f"v_{n}" for n in names) <= set(f.columns) else with_variances(f, names), names)


def calibrated(f: DataFrame, h: Horizon = YEAR, names: tuple[str, ...] = ("const", "ewma", "vix"), mu: str = "fc_level0_est") -> DataFrame:
    return dist.level_calibrated(dist.residuals(walk(f, h), variances(f, names), h, mu), h)


def fhs(f: DataFrame, h: Horizon = YEAR, names: tuple[str, ...] = ("const", "ewma", "vix"), mu: str = "fc_level0_est") -> DataFrame:
    return dist.simulated(calibrated(f, h, names, mu), h)


GRID_SQL = "[" + ", ".join(f"{0.05 * k:.2f}" for k in range(1, 20)) + "]"

BASE = f"""
o AS (SELECT unnest(CASE WHEN o_orderpriority = '{SIDE}' THEN ['main', 'side'] ELSE ['main'] END) AS index_id, o_orderdate::DATE AS date, o_orderkey, o_totalprice FROM orders),
px AS (SELECT index_id, date, avg(o_totalprice) AS p, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close FROM o GROUP BY 1, 2),
sh AS (SELECT l_shipdate::DATE AS date, avg(l_extendedprice * (1 - l_discount)) AS e, avg(l_extendedprice * l_tax) AS d, avg(l_discount) AS rate, avg(l_tax) AS spread, avg(l_quantity) AS level FROM lineitem GROUP BY 1),
va AS (SELECT index_id, date, p, e, d, rate, spread, level, CASE WHEN count(e) OVER w = 120 THEN avg(e) OVER w END AS e10 FROM px JOIN sh USING (date)
    WINDOW w AS (PARTITION BY index_id ORDER BY date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)),
vb AS (SELECT *, p / e10 AS cape, row_number() OVER (PARTITION BY index_id ORDER BY date) - 1 AS pos FROM va WHERE e10 > 0 AND p > 0),
vc AS (SELECT *, ln(p) AS log_p, ln(cape) AS log_cape, p / cape AS e10n, count(cape) OVER t = 360 AS filled,
    quantile_cont(cape, [0.5, 0.05, 0.25, 0.75, 0.95]) OVER t AS q, list(cape) OVER (PARTITION BY index_id ORDER BY pos ROWS BETWEEN 359 PRECEDING AND 1 PRECEDING) AS before
    FROM vb WINDOW t AS (PARTITION BY index_id ORDER BY pos ROWS BETWEEN 359 PRECEDING AND CURRENT ROW)),
ft AS (SELECT index_id, date, pos, p, e, d, rate, spread, level, e10, cape, log_p, log_cape, e10n, (ln(e10n) - lag(ln(e10n), 240) OVER o) / 20 AS g,
    CASE WHEN filled THEN q[1] END AS cape_star, CASE WHEN filled THEN q[2] END AS q05, CASE WHEN filled THEN q[3] END AS q25, CASE WHEN filled THEN q[4] END AS q75, CASE WHEN filled THEN q[5] END AS q95,
    CASE WHEN filled THEN len(list_filter(before, lambda x: x < cape)) / 359.0 END AS pctile, CASE WHEN filled THEN ln(q[1]) - log_cape END AS gap,
    log_p - lag(log_p) OVER o AS r FROM vc WINDOW o AS (PARTITION BY index_id ORDER BY pos))"""


def walk_sql(h: Horizon = YEAR, lag: int = 0, name: str = "og") -> str:
    """CTEs that end in `name`, the origins."""
    held = "g, gap, ln(q05) - ln(cape_star) AS off_q05, ln(q25) - ln(cape_star) AS off_q25, ln(q75) - ln(cape_star) AS off_q75, ln(q95) - ln(cape_star) AS off_q95"
    if lag:
        held = ", ".join(f"lag({x}, {lag}) OVER o AS {n}" for x, n in [("g", "g"), ("gap", "gap"), *[(f"ln(q{b}) - ln(cape_star)", f"off_q{b}") for b in ("05", "25", "75", "95")]])
    y = f"{h.steps / 12!r}"
    return f"""
{name}_a AS (SELECT index_id, date, pos, log_p, r, rate, spread, {held}, lead(log_p, {h.steps}) OVER o - log_p AS fwd FROM ft WINDOW o AS (PARTITION BY index_id ORDER BY pos)),
{name}_b AS (SELECT *, fwd IS NOT NULL AND gap IS NOT NULL AND g IS NOT NULL AS ok FROM {name}_a),
{name}_c AS (SELECT *, count(CASE WHEN ok THEN 1 END) OVER w AS n_done, sum(CASE WHEN ok THEN gap * (fwd - g * {y}) END) OVER w / nullif(sum(CASE WHEN ok THEN gap * gap END) OVER w, 0) AS lam_ols,
    avg(CASE WHEN ok THEN fwd END) OVER w AS hist_mean FROM {name}_b WINDOW w AS (PARTITION BY index_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND {h.steps} PRECEDING)),
{name}_d AS (SELECT *, CASE WHEN lam_ols IS NOT NULL THEN greatest(0.0, least({h.cap!r}, {h.shrink!r} * lam_ols + {1 - h.shrink!r} * {h.prior!r})) END AS lam_used FROM {name}_c),
{name} AS (SELECT index_id, date, pos, log_p, r, rate, spread, g, gap, fwd AS realized, lam_ols, lam_used, g * {y} + lam_used * gap AS fc_level0_est, g * {y} + {h.prior!r} * gap AS fc_level0_prior, g * {y} + gap AS fc_full_reversion,
    g * {y} AS fc_drift_only, 0.0::DOUBLE AS fc_rw_zero, hist_mean AS fc_rw_drift, {', '.join(f'g * {y} + lam_used * gap + lam_used * off_q{b} AS band_q{b}' for b in ('05', '25', '75', '95'))},
    row_number() OVER (PARTITION BY index_id ORDER BY pos) - 1 AS opos FROM {name}_d WHERE ok AND n_done >= 120)"""


LONG_SQL = "lg AS (" + " UNION ALL ".join(f"SELECT index_id, date, pos, '{p}' AS policy, fc_{p} AS fc, realized, fc_rw_drift, fc_drift_only, fc_rw_zero, band_q05, band_q25, band_q75, band_q95 FROM og" for p in ("level0_est", "level0_prior", "full_reversion", "drift_only", "rw_zero", "rw_drift")) + ")"

VOL_SQL = """
vk AS (SELECT index_id, pos, CASE WHEN count(r) OVER w >= 240 THEN var_samp(r) OVER w END AS const_v, CASE WHEN pos >= 240 THEN r END AS late FROM ft WINDOW w AS (PARTITION BY index_id ORDER BY pos ROWS BETWEEN 600 PRECEDING AND CURRENT ROW)),
s0 AS (SELECT index_id, var_pop(r) AS seed FROM ft WHERE pos < 240 GROUP BY 1),
ew AS (SELECT index_id, pos, CASE WHEN pos >= 240 THEN list_reduce(list_prepend(seed, list_filter(list(r) OVER (PARTITION BY index_id ORDER BY pos), lambda x: x IS NOT NULL)), lambda h, x: 0.94 * h + 0.06 * x * x) END AS v FROM ft JOIN s0 USING (index_id)),
vv AS (SELECT index_id, pos, 'const' AS model, const_v AS v FROM vk UNION ALL SELECT index_id, pos, 'ewma', v FROM ew UNION ALL SELECT index_id, pos, 'vix', pow(rate * 400 / 100, 2) / 12 FROM ft)"""


def fhs_sql(h: Horizon = YEAR, og: str = "og", mu: str = "fc_level0_est", name: str = "fh") -> str:
    """CTEs that end in `name`: mu, realized, resid, raw, sigma, z, quant, pit per origin and model."""
    w = f"WINDOW w AS (PARTITION BY index_id, model ORDER BY opos ROWS BETWEEN UNBOUNDED PRECEDING AND {h.steps} PRECEDING)"
    return f"""
{name}_a AS (SELECT {og}.index_id, date, {og}.pos, opos, log_p, {mu} AS mu, realized, realized - {mu} AS resid, model, sqrt({h.steps} * v) AS raw FROM {og} LEFT JOIN vv ON vv.index_id = {og}.index_id AND vv.pos = {og}.pos),
{name}_b AS (SELECT *, CASE WHEN raw IS NOT NULL AND count(mu) OVER w >= {h.min_cal} AND count(raw) OVER w >= {h.min_cal} THEN raw * sqrt(avg(CASE WHEN raw IS NOT NULL THEN resid * resid END) OVER w / avg(raw * raw) OVER w) END AS sigma FROM {name}_a {w}),
{name}_c AS (SELECT *, CASE WHEN sigma > 0 THEN resid / sigma END AS z FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN sigma IS NOT NULL AND count(z) OVER w >= {h.min_cal} THEN quantile_cont(z, {GRID_SQL}) OVER w END AS zq,
    CASE WHEN sigma IS NOT NULL AND count(z) OVER w >= {h.min_cal} THEN list_filter(list(z) OVER w, lambda x: x IS NOT NULL) END AS pool FROM {name}_c {w}),
{name} AS (SELECT *, CASE WHEN zq IS NOT NULL THEN list_transform(zq, lambda x: mu + sigma * x) END AS quant, CASE WHEN pool IS NOT NULL THEN len(list_filter(pool, lambda x: x <= resid / sigma)) / len(pool)::DOUBLE END AS pit FROM {name}_d)"""


def calibration_sql(source: str, keys: str, name: str = "cm") -> str:
    return f"""
{name}_a AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pit NULLS LAST) AS i, count(pit) OVER (PARTITION BY {keys}) AS n_pit FROM {source} WHERE quant IS NOT NULL),
{name} AS (SELECT {keys}, count(*) AS n, avg(list_sum(list_transform(list_zip({GRID_SQL}, quant), lambda x: greatest(x[1] * (realized - x[2]), (x[1] - 1) * (realized - x[2])))) / 19) AS pinball,
    max(greatest(i / n_pit::DOUBLE - pit, pit - (i - 1) / n_pit::DOUBLE)) AS pit_ks,
    {', '.join(f'avg(CASE WHEN realized >= quant[{a}] AND realized <= quant[{b}] THEN 1.0 ELSE 0.0 END) AS cover_{c}, avg(quant[{b}] - quant[{a}]) AS width_{c}' for c, a, b in (('50', 5, 15), ('80', 2, 18), ('90', 1, 19)))}
    FROM {name}_a GROUP BY {keys})"""


def sql(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
