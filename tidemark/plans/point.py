"""Queries of features and point forecasts: anchors, walk-forward policies, their scores and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import NORMAL_BOTTOM, NORMAL_TOP
from ..operators import features as feat
from ..operators import scores, walk
from ..operators.walk import YEAR, horizon
from ..sources.tables import kept
from .panel import BASE, LONG_SQL, features, panel, sql, walk_sql
from .registry import query
from .shown import picked, shown

MACRO_SPEC = [("gap", "as_is", 3), ("pctile", "as_is", 3), ("rate", "chg12", 1), ("spread", "as_is", 1), ("level", "yoy", 2)]
INDICATORS = [("cape", "bearish"), ("rate", "bullish"), ("spread", "neutral"), ("level", "bullish")]
SINCE = 1999


def normal_sql(x: str) -> str:
    poly = lambda c: "".join("(" for _ in c[1:]) + repr(c[0]) + "".join(f" * abs({x}) + {v!r})" for v in c[1:])
    tail = f"CASE WHEN abs({x}) > 7 THEN 0 ELSE exp(-({x}) * ({x}) / 2) * {poly(NORMAL_TOP)} / {poly(NORMAL_BOTTOM)} END"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def hac_sql(source: str, keys: str, x: str, y: str, order: str, name: str, lags: int = scores.HAC_LAGS) -> str:
    w = f"PARTITION BY {keys} ORDER BY {order}"
    terms = "".join(f" + 2 * {1 - k / (lags + 1)!r} * s * coalesce(lag(s, {k}) OVER ({w}), 0)" for k in range(1, lags + 1))
    return f"""
{name}_a AS (SELECT {keys}, {order}, ({x})::DOUBLE AS x, {y} AS y FROM {source}),
{name}_b AS (SELECT *, sum(x * y) OVER (PARTITION BY {keys}) / sum(x * x) OVER (PARTITION BY {keys}) AS b FROM {name}_a WHERE x IS NOT NULL AND y IS NOT NULL),
{name}_c AS (SELECT *, y - b * x AS e, x * (y - b * x) AS s FROM {name}_b),
{name}_d AS (SELECT *, s * s{terms} AS pr FROM {name}_c),
{name} AS (SELECT {keys}, count(*) AS n, any_value(b) AS beta, any_value(b) * sum(x * x) / sqrt(sum(pr)) AS t, 1 - sum(e * e) / sum(y * y) AS r2 FROM {name}_d GROUP BY {keys})"""


FEATURES = "p e10 cape log_p log_cape e10n g cape_star q05 q25 q75 q95 pctile gap"


@query(sql(BASE) + " SELECT " + picked("index_id date", FEATURES, "pos") + " FROM ft")
def k01_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(features(spark, sf_dir), f"index_id date {FEATURES} pos")


@query(sql(BASE, walk_sql()) + " SELECT " + picked("index_id date", "lam_ols lam_used hist_mean", "pos n_done") + " FROM og_d WHERE n_done >= 120")
def e07_expanding_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = walk.expanding_lambda(features(spark, sf_dir), YEAR).where("n_done >= 120")
    return shown(f, "index_id date lam_ols lam_used hist_mean pos n_done")


WALK = "realized lam_ols lam_used fc_level0_est fc_level0_prior fc_full_reversion fc_drift_only fc_rw_zero fc_rw_drift band_q05 band_q25 band_q75 band_q95"


@query(sql(BASE, walk_sql()) + " SELECT " + picked("index_id date", WALK, "pos opos") + " FROM og")
def e10_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(walk.walk(features(spark, sf_dir)), f"index_id date {WALK} pos opos")


@query(sql(BASE, walk_sql(lag=3)) + " SELECT " + picked("index_id date", WALK, "pos opos") + " FROM og")
def k34_lagged_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(walk.walk(features(spark, sf_dir), lag=3), f"index_id date {WALK} pos opos")


@query(sql(BASE, walk_sql(), LONG_SQL) + """ SELECT index_id, policy, count(*)::BIGINT AS n, round(sqrt(avg((realized - fc) * (realized - fc))), 6) AS rmse, round(avg(abs(realized - fc)), 6) AS mae, round(avg(realized - fc), 6) AS mean_error,
    round(1 - sum((realized - fc) * (realized - fc)) / sum(realized * realized), 6) AS r2_zero, round(1 - sum((realized - fc) * (realized - fc)) / sum((realized - fc_rw_drift) * (realized - fc_rw_drift)), 6) AS r2_drift,
    min(date) AS first, max(date) AS last FROM lg GROUP BY 1, 2""")
def k29_policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scores.policy_metrics(walk.policies(walk.walk(features(spark, sf_dir))))
    return shown(m, "index_id policy n rmse mae mean_error r2_zero r2_drift first last")


@query(sql(BASE, walk_sql()) + """ SELECT index_id, round(avg(CASE WHEN realized >= band_q05 AND realized <= band_q95 THEN 1.0 ELSE 0.0 END), 6) AS cover_90, round(avg(CASE WHEN realized >= band_q25 AND realized <= band_q75 THEN 1.0 ELSE 0.0 END), 6) AS cover_50,
    greatest(1, count(*) // 12)::BIGINT AS n_eff FROM og GROUP BY 1""")
def d08_band_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, r = walk.walk(features(spark, sf_dir)), F.col("realized")
    c = o.groupBy("index_id").agg(scores.hit((r >= F.col("band_q05")) & (r <= F.col("band_q95"))).alias("cover_90"), scores.hit((r >= F.col("band_q25")) & (r <= F.col("band_q75"))).alias("cover_50"), scores.effective(F.count(F.lit(1)), 12).alias("n_eff"))
    return shown(c, "index_id cover_90 cover_50 n_eff")


_ERAS = (("all", 0), ("late", SINCE), ("last", 2000))


@query(sql(BASE, walk_sql(), LONG_SQL) + " UNION ALL ".join(f""" SELECT index_id, policy, '{n}' AS era, count(*)::BIGINT AS n, round(1 - sum((realized - fc) * (realized - fc)) / sum((realized - fc_rw_drift) * (realized - fc_rw_drift)), 6) AS r2_mean,
    round(1 - sum((realized - fc) * (realized - fc)) / sum((realized - fc_drift_only) * (realized - fc_drift_only)), 6) AS r2_drift_only FROM lg WHERE year(date) >= {y} GROUP BY 1, 2""" for n, y in _ERAS))
def k27_subperiods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = walk.policies(walk.walk(features(spark, sf_dir)))
    eras = F.array(*[F.struct(F.lit(n).alias("era"), F.lit(y).alias("since")) for n, y in _ERAS])
    p = p.withColumn("x", F.explode(eras)).where(F.year("date") >= F.col("x.since"))
    r, f = F.col("realized"), F.col("fc")
    m = p.groupBy("index_id", "policy", F.col("x.era").alias("era")).agg(F.count(F.lit(1)).alias("n"), scores.r2(r, f, F.col("fc_rw_drift")).alias("r2_mean"), scores.r2(r, f, F.col("fc_drift_only")).alias("r2_drift_only"))
    return shown(m, "index_id policy era n r2_mean r2_drift_only")


@query(sql(BASE, walk_sql(), LONG_SQL) + f""" SELECT coalesce(index_id, 'all') AS index_id, coalesce(policy, 'all') AS policy, CASE WHEN late THEN 'late' ELSE 'all' END AS era, count(*)::BIGINT AS n, round(1 - sum((realized - fc) * (realized - fc)) / sum((realized - fc_rw_drift) * (realized - fc_rw_drift)), 6) AS r2_mean,
    round(1 - sum((realized - fc) * (realized - fc)) / nullif(sum((realized - fc_drift_only) * (realized - fc_drift_only)), 0), 6) AS r2_drift_only FROM (SELECT *, year(date) >= {SINCE} AS late FROM lg) GROUP BY GROUPING SETS ((index_id, policy, late), (index_id, policy), (policy), (index_id), ()) HAVING grouping(index_id, policy, late) <> 0 OR late""")
def k27_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by series, policy and era with their totals, in one pass."""
    p = walk.policies(walk.walk(features(spark, sf_dir)))
    return shown(scores.metrics_by_sets(p, SINCE), "index_id policy era n r2_mean r2_drift_only")


_GAIN = "(realized - fc_rw_drift) * (realized - fc_rw_drift) - (realized - fc_level0_est) * (realized - fc_level0_est)"


@query(sql(BASE, walk_sql()) + f" SELECT index_id, round(sum(CASE WHEN year(date) < {SINCE} THEN {_GAIN} END) / sum({_GAIN}), 6) AS early_share FROM og GROUP BY 1")
def d07_early_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    gain = F.expr(_GAIN)
    a = walk.walk(features(spark, sf_dir)).groupBy("index_id").agg(F.try_divide(F.sum(F.when(F.year("date") < SINCE, gain)), F.sum(gain)).alias("early_share"))
    return shown(a, "index_id early_share")


@query(sql(BASE, walk_sql(), hac_sql("og_b", "index_id", "CASE WHEN ok THEN gap END", "fwd - g", "pos", "hc")) + " SELECT index_id, n::BIGINT AS n, round(beta, 6) AS beta, round(t, 6) AS t, round(r2, 6) AS r2 FROM hc")
def d10_lambda_hac(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = walk.completed(features(spark, sf_dir), YEAR)
    return shown(scores.hac(f, F.when(F.col("ok"), F.col("gap")), F.col("fwd") - F.col("g"), ["index_id"], "pos"), "index_id n beta t r2")


_CW = "(realized - {s}) * (realized - {s}) - ((realized - {l}) * (realized - {l}) - ({s} - {l}) * ({s} - {l}))"


@query(sql(BASE, walk_sql(), hac_sql("og", "index_id", "1", _CW.format(s="fc_rw_drift", l="fc_level0_est"), "pos", "cw")) + f" SELECT index_id, n::BIGINT AS n, round(t, 6) AS cw_t, round(1 - {normal_sql('abs(t)')}, 6) AS cw_p_halved, round(1 - {normal_sql('t')}, 6) AS cw_p_onesided FROM cw")
def d11_clark_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = walk.walk(features(spark, sf_dir))
    return shown(scores.clark_west(o, F.col("realized"), F.col("fc_rw_drift"), F.col("fc_level0_est"), ["index_id"], "pos"), "index_id n cw_t cw_p_halved cw_p_onesided")


@query(sql(BASE, "tr AS (SELECT *, count(log_p) OVER w = 240 AS filled, regr_slope(log_p, pos) OVER w AS b, regr_intercept(log_p, pos) OVER w AS a FROM ft WINDOW w AS (PARTITION BY index_id ORDER BY pos ROWS BETWEEN 239 PRECEDING AND CURRENT ROW))") + " SELECT index_id, date, round(a + b * pos, 5) AS trend, round(12 * b, 6) AS trend_growth, round(a + b * pos - log_p, 5) AS trend_gap FROM tr WHERE filled")
def e24_rolling_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = feat.rolling_trend(features(spark, sf_dir)).where("trend IS NOT NULL")
    return t.select("index_id", "date", F.round("trend", 5).alias("trend"), F.round("trend_growth", 6).alias("trend_growth"), F.round("trend_gap", 5).alias("trend_gap"))


def _kind(c: str, kind: str) -> str:
    return {"as_is": c, "chg12": f"{c} - lag({c}, 12) OVER o", "yoy": f"ln({c}) - lag(ln({c}), 12) OVER o"}[kind]


_MACRO = f"""ma AS (SELECT index_id, date, pos, {', '.join(f'{_kind(c, k)} AS {c}_{k}' for c, k, _ in MACRO_SPEC)} FROM ft WINDOW o AS (PARTITION BY index_id ORDER BY pos)),
mx AS (SELECT index_id, date, pos, {', '.join(f'lag({c}_{k}, {n}) OVER o AS {c}_{k}' for c, k, n in MACRO_SPEC)} FROM ma WINDOW o AS (PARTITION BY index_id ORDER BY pos))"""
_NAMES = " ".join(f"{c}_{k}" for c, k, _ in MACRO_SPEC)


@query(sql(BASE, _MACRO) + " SELECT " + picked("index_id date", _NAMES, "pos") + " FROM mx")
def k17_macro_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(feat.transformed(features(spark, sf_dir), MACRO_SPEC), f"index_id date {_NAMES} pos")


@query(sql(BASE, _MACRO, walk_sql(), f"er AS (SELECT og.index_id, abs(realized - fc_level0_est) AS ae, {', '.join(_NAMES.split())} FROM og JOIN mx USING (index_id, pos))", "co AS (" + " UNION ALL ".join(f"SELECT index_id, '{n}' AS feature, corr({n}, ae) AS c FROM er GROUP BY 1" for n in _NAMES.split()) + "), cr AS (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY abs(c) DESC NULLS LAST, feature) AS rank FROM co)") + " SELECT index_id, feature, round(c, 6) AS correlation, rank::BIGINT AS rank FROM cr WHERE rank <= 4")
def k18_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    f = features(spark, sf_dir)
    o = walk.walk(f).select("index_id", "pos", F.abs(F.col("realized") - F.col("fc_level0_est")).alias("ae"))
    j = o.join(feat.transformed(f, MACRO_SPEC), ["index_id", "pos"])
    c = feat.long(j, _NAMES.split(), ("index_id", "ae")).groupBy("index_id", F.col("key").alias("feature")).agg(F.corr("value", "ae").alias("correlation"))
    rank = F.row_number().over(Window.partitionBy("index_id").orderBy(F.abs("correlation").desc_nulls_last(), "feature"))
    return shown(c.withColumn("rank", rank).where("rank <= 4"), "index_id feature correlation rank")


@query(sql(BASE, "il AS (UNPIVOT (SELECT index_id, date, cape, rate, spread, level FROM ft) ON cape, rate, spread, level INTO NAME key VALUE value)",
    "iy AS (SELECT index_id, key, date, CASE WHEN key = 'level' THEN 100 * (ln(value) - lag(ln(value), 12) OVER (PARTITION BY index_id, key ORDER BY date)) ELSE value END AS value FROM il)",
    "ib AS (SELECT *, row_number() OVER (PARTITION BY index_id, key ORDER BY date DESC) AS back, count(value) OVER (PARTITION BY index_id, key) AS n, arg_max(value, date) OVER (PARTITION BY index_id, key) AS last FROM iy WHERE value IS NOT NULL)",
    "ig AS (SELECT index_id, key, max(last) AS value, avg(CASE WHEN n < 24 OR back <= 120 THEN value END) AS m, stddev_samp(CASE WHEN n < 24 OR back <= 120 THEN value END) AS s, avg(CASE WHEN value < last THEN 1.0 ELSE 0.0 END) AS pctile, max(date) AS \"asof\", CASE key WHEN 'cape' THEN 'bearish' WHEN 'spread' THEN 'neutral' ELSE 'bullish' END AS direction FROM ib GROUP BY 1, 2)") +
    " SELECT index_id, key, round(value, 6) AS value, round((value - m) / s, 6) AS z, round(pctile, 6) AS pctile, direction, round(CASE direction WHEN 'bearish' THEN -(value - m) / s WHEN 'bullish' THEN (value - m) / s ELSE 0 END, 6) AS stance, \"asof\" FROM ig")
def h01_indicator_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = feat.indicator_panel(features(spark, sf_dir), INDICATORS, yoy=["level"])
    return shown(p.withColumn("stance", feat.stance(F.col("z"), F.col("direction"))), "index_id key value z pctile direction stance asof")


def _predictors() -> dict:
    return {"div_yield": F.try_divide("d", "p"), "earn_yield": F.try_divide("e", "p"), "cape_yield": 1 / F.col("cape"), "term_spread": F.col("spread")}


_PREDICTOR_SQL = {"div_yield": "d / p", "earn_yield": "e / p", "cape_yield": "1 / cape", "term_spread": "spread"}


def regression_sql(h=YEAR, name: str = "rg") -> str:
    w = f"(PARTITION BY index_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND {h.steps} PRECEDING)"
    each = " UNION ALL ".join(f"SELECT index_id, date, pos, '{n}' AS model, CASE WHEN regr_count(y, x) OVER w >= 120 AND x IS NOT NULL THEN regr_intercept(y, x) OVER w + regr_slope(y, x) OVER w * x END AS fc FROM (SELECT index_id, date, pos, lead(log_p, {h.steps}) OVER (PARTITION BY index_id ORDER BY pos) - log_p AS y, {x} AS x FROM ft) WINDOW w AS {w}" for n, x in _PREDICTOR_SQL.items())
    return f"{name} AS ({each})"


@query(sql(BASE, regression_sql()) + " SELECT index_id, pos::BIGINT AS pos, model, round(fc, 6) AS fc FROM rg WHERE fc IS NOT NULL")
def e26_predictive_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = walk.predictive_regressions(features(spark, sf_dir), _predictors())
    out = feat.long(r, [f"fc_{n}" for n in _predictors()], ("index_id", "pos")).where("value IS NOT NULL")
    return shown(out.select("index_id", "pos", F.substring("key", 4, 99).alias("model"), F.col("value").alias("fc")), "index_id pos model fc")


@query()
def e27_kitchen_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(walk.kitchen_sink(features(spark, sf_dir), list(_predictors().values())), "index_id pos fc")


#: The horizons that are ranked.
BOARD_HORIZONS = ("12mo", "36mo", "60mo", "120mo")


def forecasts(f: DataFrame, h=YEAR, kitchen: bool = True) -> DataFrame:
    """index_id, date, pos, realized, bench, model, fc of a panel: every model from the windows of one sort."""
    o = walk.walk(f, h, predictors=_predictors())
    columns = {"rw_zero": "fc_rw_zero", "hist_mean": "fc_rw_drift", "drift_only": "fc_drift_only", "level0": "fc_level0_est", **{n: f"fc_{n}" for n in _predictors()}}
    if kitchen:
        o = o.join(walk.kitchen_sink(f, list(_predictors().values()), h).withColumnRenamed("fc", "fc_goyal_welch"), ["index_id", "pos"], "left")
        columns["goyal_welch"] = "fc_goyal_welch"
    x = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("fc")) for n, c in columns.items()]))
    return o.select("index_id", "date", "pos", "realized", F.col("fc_rw_drift").alias("bench"), x.alias("x")).select("index_id", "date", "pos", "realized", "bench", "x.*")


def board(f: DataFrame, h=YEAR, kitchen: bool = False) -> DataFrame:
    return scores.point_leaderboard(kept(forecasts(f, h, kitchen)), h.steps, SINCE)


BOARD = "index_id model oos_r2 oos_r2_late dir_hit cw_t cw_p_halved verdict n n_eff first last rank"


def board_ctes(h=YEAR, k: str = "") -> list[str]:
    """CTEs that end in bd{k}, the ranked models of one horizon."""
    og = f"og{k}"
    own = {"rw_zero": "fc_rw_zero", "hist_mean": "fc_rw_drift", "drift_only": "fc_drift_only", "level0": "fc_level0_est"}
    base = "SELECT index_id, date, pos, realized, fc_rw_drift AS bench"
    return [
        walk_sql(h, name=og), regression_sql(h, f"rg{k}"),
        f"pf{k} AS (" + " UNION ALL ".join(f"{base}, '{m}' AS model, {c} AS fc FROM {og}" for m, c in own.items()) + f" UNION ALL SELECT {og}.index_id, {og}.date, {og}.pos, realized, fc_rw_drift, model, fc FROM {og} JOIN rg{k} AS rg ON rg.index_id = {og}.index_id AND rg.pos = {og}.pos)",
        f"pg{k} AS (SELECT * FROM pf{k} WHERE fc IS NOT NULL AND bench IS NOT NULL)",
        hac_sql(f"(SELECT * FROM pg{k} WHERE model <> 'hist_mean')", "index_id, model", "1", _CW.format(s="bench", l="fc"), "pos", f"cw{k}"),
        f"""pb{k} AS (SELECT index_id, model, 1 - sum((realized - fc) * (realized - fc)) / sum((realized - bench) * (realized - bench)) AS oos_r2,
    CASE WHEN count(CASE WHEN year(date) >= {SINCE} THEN 1 END) >= 24 THEN 1 - sum(CASE WHEN year(date) >= {SINCE} THEN (realized - fc) * (realized - fc) END) / sum(CASE WHEN year(date) >= {SINCE} THEN (realized - bench) * (realized - bench) END) END AS oos_r2_late,
    avg(CASE WHEN sign(fc) = sign(realized) THEN 1.0 ELSE 0.0 END) AS dir_hit, count(*) AS n, min(date) AS first, max(date) AS last FROM pg{k} GROUP BY 1, 2 HAVING count(*) >= 24)""",
        f"pl{k} AS (SELECT pb{k}.*, cw{k}.t AS cw_t, 1 - {normal_sql(f'abs(cw{k}.t)')} AS p FROM pb{k} LEFT JOIN cw{k} USING (index_id, model))",
        f"""bd{k} AS (SELECT index_id, model, round(oos_r2, 6) AS oos_r2, round(oos_r2_late, 6) AS oos_r2_late, round(dir_hit, 6) AS dir_hit, round(cw_t, 6) AS cw_t, round(CASE WHEN cw_t IS NOT NULL THEN p END, 6) AS cw_p_halved,
    CASE WHEN model = 'hist_mean' THEN 'reference' WHEN p < 0.05 AND oos_r2 > 0 THEN 'beats_mean' WHEN oos_r2 > 0 THEN 'tie' ELSE 'loses_to_mean' END AS verdict, n::BIGINT AS n, greatest(1, n // {h.steps})::BIGINT AS n_eff, first, last,
    (row_number() OVER (PARTITION BY index_id ORDER BY oos_r2 DESC NULLS LAST, model))::BIGINT AS rank FROM pl{k})""",
    ]


@query(sql(BASE, *board_ctes()) + " SELECT * FROM bd")
def k13_point_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(board(panel(spark, sf_dir)), BOARD)


@query(sql(BASE, *[c for k in BOARD_HORIZONS for c in board_ctes(horizon(k), k)]) + " UNION ALL ".join(f" SELECT '{k}' AS horizon, * FROM bd{k}" for k in BOARD_HORIZONS))
def k13_point_leaderboard_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = panel(spark, sf_dir)
    return over_horizons(BOARD_HORIZONS, lambda h: shown(board(f, h), BOARD))


def over_horizons(keys, made) -> DataFrame:
    """The rows that made(horizon) gives for each key, with the key as column horizon."""
    out = None
    for k in keys:
        one = made(horizon(k)).withColumn("horizon", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def k13_point_leaderboard_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the regression on all predictors at once, whose solves are Python."""
    f = panel(spark, sf_dir)
    return over_horizons(BOARD_HORIZONS, lambda h: shown(board(f, h, kitchen=True), BOARD))


@query(sql(BASE, f"nw AS (SELECT index_id, date, pos, log_p, realized, CASE WHEN count(realized) OVER w >= 120 THEN avg(realized) OVER w END AS mu FROM (SELECT *, lead(log_p, 6) OVER (PARTITION BY index_id ORDER BY pos) - log_p AS realized FROM ft) WINDOW w AS (PARTITION BY index_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING))") + " SELECT index_id, date, round(realized, 6) AS realized, round(mu, 6) AS mu, (row_number() OVER (PARTITION BY index_id ORDER BY pos) - 1)::BIGINT AS opos FROM nw WHERE realized IS NOT NULL AND mu IS NOT NULL")
def e23_neutral_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(walk.neutral_walk(features(spark, sf_dir), horizon("6mo")), "index_id date realized mu opos")
