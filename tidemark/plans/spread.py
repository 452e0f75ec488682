"""Queries of volatility, predictive distributions, their calibration and what is decided on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import NORMAL_GRID, T5_GRID
from ..functions.sql import register
from ..operators import distribution as dist
from ..operators import document, scores, series, volatility, walk
from ..operators import features as feat
from ..operators.walk import HORIZONS, YEAR, horizon
from ..sources.tables import kept, leaves_of, shared_dir
from .panel import ALL, BASE, GRID_SQL, VOL_SQL, calibrated, calibration_sql, features, fhs, fhs_sql, panel, sql, variances, walk_sql, with_variances
from .point import BOARD_HORIZONS, INDICATORS, _PREDICTOR_SQL, _predictors, board, board_ctes, normal_sql, over_horizons
from .registry import query
from .shown import picked, shown

FHS = sql(BASE, walk_sql(), VOL_SQL, fhs_sql())
CAL = "n pinball pit_ks cover_50 cover_80 cover_90 width_50 width_80 width_90"
_CAL_SQL = picked("index_id model", CAL[2:], "n")
_LEVELS = ("q05", 0), ("q25", 4), ("q50", 9), ("q75", 14), ("q95", 18)


def levels(df: DataFrame, column: str = "quant") -> DataFrame:
    return df.withColumns({n: F.get(column, F.lit(i)) for n, i in _LEVELS})


def at_sql(column: str = "quant") -> str:
    return ", ".join(f"round({column}[{i + 1}], 6) AS {n}" for n, i in _LEVELS)


@query(sql(BASE, VOL_SQL) + " SELECT " + picked("index_id model", "", "pos") + ", round(v, 9) AS v FROM vv WHERE v IS NOT NULL")
def e14_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variances(features(spark, sf_dir)).where("v IS NOT NULL")
    return v.select("index_id", "model", F.col("pos").cast("long").alias("pos"), F.round("v", 9).alias("v"))


@query()
def e15_garch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted anew every 12 rows on all returns so far; `failed` counts the fits that gave nothing."""
    g = volatility.garch(features(spark, sf_dir)).where("v_garch IS NOT NULL")
    return shown(g.withColumnsRenamed({"v_garch": "v", "v_garch_failed": "failed"}), "index_id pos v failed")


@query(FHS + " SELECT " + picked("index_id model date", "raw sigma z", "opos") + " FROM fh WHERE sigma IS NOT NULL")
def e19_level_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(calibrated(panel(spark, sf_dir)).where("sigma IS NOT NULL"), "index_id model date raw sigma z opos")


@query(FHS + " SELECT " + picked("index_id model date", "realized pit", "opos") + f", {at_sql()} FROM fh WHERE quant IS NOT NULL")
def e20_simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = levels(fhs(panel(spark, sf_dir)).where("quant IS NOT NULL"))
    return shown(q, "index_id model date realized pit opos q05 q25 q50 q75 q95")


@query(sql(BASE, walk_sql(), VOL_SQL, fhs_sql(), calibration_sql("fh", "index_id, model")) + f" SELECT {_CAL_SQL} FROM cm")
def d17_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scores.calibration(fhs(panel(spark, sf_dir)), ["index_id", "model"]), f"index_id model {CAL}")


@query(FHS + f" SELECT index_id, model, round(a, 6) AS level, round(avg(greatest(a * (realized - q), (a - 1) * (realized - q))), 6) AS loss FROM (SELECT index_id, model, realized, unnest({GRID_SQL})::DOUBLE AS a, unnest(quant) AS q FROM fh WHERE quant IS NOT NULL) GROUP BY 1, 2, a")
def d16_pinball_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scores.pinball(fhs(panel(spark, sf_dir)), ["index_id", "model"]), "index_id model level loss")


@query(FHS + """ SELECT index_id, model, b::BIGINT AS bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT index_id, model FROM fh WHERE pit IS NOT NULL) CROSS JOIN generate_series(1, 10) g(b)
    LEFT JOIN (SELECT index_id, model, least(floor(pit * 10)::INT + 1, 10) AS b, count(*) AS n FROM fh WHERE pit IS NOT NULL GROUP BY 1, 2, 3) USING (index_id, model, b)""")
def d19_pit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scores.pit_histogram(fhs(panel(spark, sf_dir)), ["index_id", "model"]), "index_id model bin n")


def common_window(rows: DataFrame) -> DataFrame:
    """Rows of origins at which every model has a distribution."""
    return rows.withColumn("_all", F.bool_and(F.col("quant").isNotNull()).over(Window.partitionBy("index_id", "opos"))).where("_all").drop("_all")


_COMMON = "fw AS (SELECT * FROM (SELECT *, bool_and(quant IS NOT NULL) OVER (PARTITION BY index_id, opos) AS whole FROM fh) WHERE whole)"


@query(sql(BASE, walk_sql(), VOL_SQL, fhs_sql(), _COMMON, calibration_sql("fw", "index_id, model")) + f" SELECT {_CAL_SQL}, n // 12 >= 1 AS enough FROM cm")
def k31_common_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scores.calibration(common_window(fhs(panel(spark, sf_dir))), ["index_id", "model"])
    return shown(c.withColumn("enough", F.floor(F.col("n") / 12) >= 1), f"index_id model {CAL} enough")


@query(sql(BASE, walk_sql(), VOL_SQL, fhs_sql(), f"""bw AS (SELECT *, bool_and(quant IS NOT NULL) OVER (PARTITION BY index_id, opos) AS whole FROM fh),
bx AS (SELECT *, row_number() OVER (PARTITION BY index_id, model ORDER BY pit NULLS LAST) AS i, count(pit) OVER (PARTITION BY index_id, model) AS m, row_number() OVER (PARTITION BY index_id, model, whole ORDER BY pit NULLS LAST) AS j, count(pit) OVER (PARTITION BY index_id, model, whole) AS l FROM bw WHERE quant IS NOT NULL)""")
    + f""" SELECT index_id, model, CASE WHEN grouping(whole) = 1 THEN 'own' ELSE 'common' END AS "window", count(*)::BIGINT AS n, round(avg(list_sum(list_transform(list_zip({GRID_SQL}, quant), lambda x: greatest(x[1] * (realized - x[2]), (x[1] - 1) * (realized - x[2])))) / 19), 6) AS pinball,
    round(CASE WHEN grouping(whole) = 1 THEN max(greatest(i / m::DOUBLE - pit, pit - (i - 1) / m::DOUBLE)) ELSE max(greatest(j / l::DOUBLE - pit, pit - (j - 1) / l::DOUBLE)) END, 6) AS pit_ks,
    {', '.join(f'round(avg(CASE WHEN realized >= quant[{a}] AND realized <= quant[{b}] THEN 1.0 ELSE 0.0 END), 6) AS cover_{c}, round(avg(quant[{b}] - quant[{a}]), 6) AS width_{c}' for c, a, b in (('50', 5, 15), ('80', 2, 18), ('90', 1, 19)))}
    FROM bx GROUP BY GROUPING SETS ((index_id, model), (index_id, model, whole)) HAVING grouping(whole) = 1 OR whole""")
def k31_both_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model on its own window and on the one that all share, in one pass."""
    rows = fhs(panel(spark, sf_dir))
    rows = rows.withColumn("_all", F.bool_and(F.col("quant").isNotNull()).over(Window.partitionBy("index_id", "opos")))
    return shown(scores.calibration_by_window(rows, ["index_id", "model"], "_all"), f"index_id model window {CAL}")


@query(sql(BASE, walk_sql(), VOL_SQL, fhs_sql(), _COMMON, calibration_sql("fw", "index_id, model")) + " SELECT index_id, arg_min(model, (pinball, model)) AS winner, round(min(pinball), 6) AS pinball, count(CASE WHEN cover_90 BETWEEN 0.86 AND 0.94 THEN 1 END)::BIGINT AS passed FROM cm WHERE n >= 24 GROUP BY 1")
def k11_volatility_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scores.gate(scores.calibration(common_window(fhs(panel(spark, sf_dir))), ["index_id", "model"])).where("n >= 24")
    a = c.groupBy("index_id").agg(F.min_by("model", F.struct("pinball", "model")).alias("winner"), F.min("pinball").alias("pinball"), F.count(F.when(F.col("passed"), 1)).alias("passed"))
    return shown(a, "index_id winner pinball passed")


_KEYS = tuple(h.key for h in HORIZONS)
_TWO_SQL = VOL_SQL.replace("UNION ALL SELECT index_id, pos, 'vix', pow(rate * 400 / 100, 2) / 12 FROM ft", "")


@query(sql(BASE, _TWO_SQL, *[x for k in _KEYS for x in (walk_sql(horizon(k), name=f"o{k}"), fhs_sql(horizon(k), og=f"o{k}", name=f"f{k}"), calibration_sql(f"f{k}", "index_id, model", f"c{k}"))])
    + " UNION ALL ".join(f" SELECT '{k}' AS horizon, {_CAL_SQL}, greatest(1, n // {horizon(k).steps})::BIGINT AS n_eff FROM c{k}" for k in _KEYS))
def e22_multi_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = kept(with_variances(features(spark, sf_dir), ("const", "ewma")))
    one = lambda h: scores.calibration(fhs(f, h, ("const", "ewma")), ["index_id", "model"]).withColumn("n_eff", scores.effective(F.col("n"), h.steps))
    return shown(over_horizons(_KEYS, one), f"horizon index_id model {CAL} n_eff")


@query()
def e22_multi_horizon_garch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All horizons from variances fitted once: each model on the window that const, ewma and garch share, long horizons with a bootstrap of their coverage."""
    names = ("const", "ewma", "garch")
    f = with_variances(features(spark, sf_dir), names)

    def one(h: walk.Horizon) -> DataFrame:
        rows = kept(common_window(fhs(f, h, names)))
        c = scores.calibration(rows, ["index_id", "model"]).withColumns({"n_eff": scores.effective(F.col("n"), h.steps), "tier": F.lit(h.tier)})
        if h.tier != "long-run":
            return c.withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
        inside = (F.col("realized") >= F.get("quant", F.lit(0))) & (F.col("realized") <= F.get("quant", F.lit(18)))
        return c.join(scores.block_bootstrap(rows, inside, ["index_id", "model"], "opos", h.steps), ["index_id", "model"])

    return shown(over_horizons(_KEYS, one), f"horizon tier index_id model {CAL} n_eff lo hi")


def _shapes(f: DataFrame, h=YEAR, model: str = "ewma", own: str = "fhs") -> DataFrame:
    return dist.shapes(calibrated(f, h, (model,)), h, own)


def _t5(x: str) -> str:
    a = f"atan(({x}) / sqrt(5))"
    return f"(0.5 + ({a} + sin({a}) * cos({a}) * (1 + pow(cos({a}), 2) * 2 / 3)) / pi())"


def shapes_ctes(h=YEAR, k: str = "") -> list[str]:
    """CTEs that end in sq{k}, four shapes a row, from fh{k}."""
    return [f"""sp{k} AS (SELECT index_id, date, opos, mu, realized, resid, sigma, quant, pit FROM fh{k} WHERE model = 'ewma'),
hs{k} AS (SELECT index_id, opos, CASE WHEN count(resid) OVER w >= {h.min_cal} THEN quantile_cont(resid, {GRID_SQL}) OVER w END AS hq, list(resid) OVER w AS pool FROM sp{k} WINDOW w AS (PARTITION BY index_id ORDER BY opos ROWS BETWEEN UNBOUNDED PRECEDING AND {h.steps} PRECEDING)),
sq{k} AS (SELECT index_id, date, opos, realized, 'fhs' AS model, quant, pit FROM sp{k} WHERE quant IS NOT NULL
    UNION ALL SELECT index_id, date, opos, realized, 'gaussian', list_transform([{', '.join(map(repr, NORMAL_GRID))}], lambda x: mu + sigma * x), {normal_sql('(resid / sigma)')} FROM sp{k} WHERE quant IS NOT NULL
    UNION ALL SELECT index_id, date, opos, realized, 'student_t', list_transform([{', '.join(map(repr, T5_GRID))}], lambda x: mu + sigma * x), {_t5('resid / sigma / sqrt(0.6)')} FROM sp{k} WHERE quant IS NOT NULL
    UNION ALL SELECT sp.index_id, date, sp.opos, realized, 'historical', list_transform(hq, lambda x: mu + x), len(list_filter(pool, lambda x: x <= resid)) / len(pool)::DOUBLE FROM sp{k} AS sp JOIN hs{k} AS hs ON hs.index_id = sp.index_id AND hs.opos = sp.opos WHERE quant IS NOT NULL)"""]


def dist_ctes(h=YEAR, k: str = "", og: str = "og") -> list[str]:
    """CTEs that end in db{k}, the ranked shapes of one horizon."""
    board = f"""db{k} AS (SELECT {_CAL_SQL}, (row_number() OVER (PARTITION BY index_id ORDER BY pinball, model))::BIGINT AS rank, CASE WHEN row_number() OVER (PARTITION BY index_id ORDER BY pinball, model) = 1 THEN 'best' END AS verdict FROM cm{k})"""
    return [fhs_sql(h, og=og, name=f"fh{k}"), *shapes_ctes(h, k), calibration_sql(f"sq{k}", "index_id, model", f"cm{k}"), board]


@query(sql(BASE, walk_sql(), VOL_SQL, fhs_sql(), *shapes_ctes()) + " SELECT " + picked("index_id model date", "pit", "opos") + f", {at_sql()} FROM sq")
def e28_parametric_fans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(levels(_shapes(panel(spark, sf_dir))), "index_id model date pit opos q05 q25 q50 q75 q95")


def dist_board(f: DataFrame, h=YEAR, model: str = "ewma", own: str = "fhs") -> DataFrame:
    return shown(scores.distribution_leaderboard(scores.calibration(_shapes(f, h, model, own), ["index_id", "model"])), f"index_id model {CAL} rank verdict")


@query(sql(BASE, walk_sql(), VOL_SQL, *dist_ctes()) + " SELECT * FROM db")
def k14_distribution_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist_board(panel(spark, sf_dir))


@query(sql(BASE, VOL_SQL, *[c for k in BOARD_HORIZONS for c in (walk_sql(horizon(k), name=f"og{k}"), *dist_ctes(horizon(k), k, f"og{k}"))]) + " UNION ALL ".join(f" SELECT '{k}' AS horizon, * FROM db{k} WHERE n >= 24" for k in BOARD_HORIZONS))
def k14_distribution_leaderboard_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = kept(with_variances(features(spark, sf_dir), ("ewma",)))
    return over_horizons(BOARD_HORIZONS, lambda h: dist_board(f, h).where("n >= 24"))


@query()
def k14_distribution_leaderboard_garch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked horizons with variances from GARCH."""
    f = with_variances(features(spark, sf_dir), ("garch",))
    return over_horizons(BOARD_HORIZONS, lambda h: dist_board(f, h, "garch", "garch_fhs").where("n >= 24"))


def headline_sql(k: str = "", key: str = "") -> str:
    """Selects from bd{k} and db{k}."""
    return f"""SELECT {key} p.index_id, round(increment, 6) AS increment, round(increment_late, 6) AS increment_late, beating, {len(_PREDICTOR_SQL)}::BIGINT AS predictors, n_eff, c.model AS best_distribution
    FROM (SELECT index_id, max(CASE WHEN model = 'level0' THEN oos_r2 END) - max(CASE WHEN model = 'drift_only' THEN oos_r2 END) AS increment, max(CASE WHEN model = 'level0' THEN oos_r2_late END) - max(CASE WHEN model = 'drift_only' THEN oos_r2_late END) AS increment_late,
        count(CASE WHEN verdict = 'beats_mean' AND model IN ({', '.join(map(repr, _PREDICTOR_SQL))}) THEN 1 END)::BIGINT AS beating, max(CASE WHEN model = 'level0' THEN n_eff END) AS n_eff FROM bd{k} GROUP BY 1) p LEFT JOIN db{k} c ON c.index_id = p.index_id AND c.rank = 1"""


_HEAD = "index_id increment increment_late beating predictors n_eff best_distribution"


def _headline(f: DataFrame, h=YEAR) -> DataFrame:
    return shown(scores.headline(shown(board(f, h), "index_id model oos_r2 oos_r2_late verdict n_eff"), dist_board(f, h), list(_predictors())), _HEAD)


@query(sql(BASE, *board_ctes(), VOL_SQL, *dist_ctes()) + headline_sql())
def k15_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headline(kept(with_variances(features(spark, sf_dir), ("ewma",))))


@query(sql(BASE, VOL_SQL, *[c for k in BOARD_HORIZONS for c in (*board_ctes(horizon(k), k), *dist_ctes(horizon(k), k, f"og{k}"))]) + " UNION ALL ".join(headline_sql(k, f"'{k}' AS horizon,") for k in BOARD_HORIZONS))
def k15_headline_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = kept(with_variances(features(spark, sf_dir), ("ewma",)))
    return over_horizons(BOARD_HORIZONS, lambda h: _headline(f, h))


_LOGVAR = """nf AS (SELECT og.index_id, og.date, og.opos, fc_level0_est AS mu, realized, realized - fc_level0_est AS resid, og.spread, CASE WHEN og.spread IS NOT NULL THEN ln(greatest(pow(realized - fc_level0_est, 2), 1e-6)) END AS y FROM og),
ng AS (SELECT *, count(y) OVER w >= 120 AND spread IS NOT NULL AS ok, regr_intercept(y, spread) OVER w + regr_slope(y, spread) OVER w * spread AS fit, sqrt(avg(resid * resid) OVER w) AS size FROM nf WINDOW w AS (PARTITION BY index_id ORDER BY opos ROWS BETWEEN UNBOUNDED PRECEDING AND 12 PRECEDING)),
nh AS (SELECT *, CASE WHEN ok THEN greatest(0.3 * size, least(3 * size, sqrt(exp(greatest(-20, least(20, fit)))))) END AS sigma FROM ng)"""


@query(sql(BASE, walk_sql(), _LOGVAR) + " SELECT " + picked("index_id date", "sigma", "opos") + ", round(resid / sigma, 6) AS z FROM nh WHERE sigma IS NOT NULL")
def e17_log_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_log_variance(panel(spark, sf_dir)).where("sigma IS NOT NULL"), "index_id date sigma opos z")


def _log_variance(f: DataFrame) -> DataFrame:
    rows = dist.residuals(walk.walk(f), variances(f, ("const",)), YEAR).join(f.select("index_id", F.col("pos").cast("long").alias("pos"), "spread"), ["index_id", "pos"])
    return dist.log_variance(rows.withColumn("model", F.lit("spread")), "spread", YEAR).drop("spread")


@query(sql(BASE, walk_sql(), _LOGVAR) + " SELECT index_id, 'spread' AS model, round(median(sigma), 6) AS sigma, count(*)::BIGINT AS of FROM (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY opos DESC) AS back FROM nh WHERE sigma IS NOT NULL) WHERE back <= 12 GROUP BY 1")
def d28_recent_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a live forecast takes where the best model has no variance of its own at the last row."""
    return shown(dist.recent_sigma(_log_variance(panel(spark, sf_dir))), "index_id model sigma of")


_WITH_SPREAD = f"""nz AS (SELECT *, 'spread' AS model, resid / sigma AS z FROM nh),
nq AS (SELECT *, CASE WHEN sigma IS NOT NULL AND count(z) OVER w >= 120 THEN quantile_cont(z, {GRID_SQL}) OVER w END AS zq, CASE WHEN sigma IS NOT NULL AND count(z) OVER w >= 120 THEN list_filter(list(z) OVER w, lambda x: x IS NOT NULL) END AS pool
    FROM nz WINDOW w AS (PARTITION BY index_id ORDER BY opos ROWS BETWEEN UNBOUNDED PRECEDING AND 12 PRECEDING)),
both4 AS (SELECT index_id, date, model, opos, mu, realized, quant, pit FROM fh UNION ALL SELECT index_id, date, model, opos, mu, realized, list_transform(zq, lambda x: mu + sigma * x), len(list_filter(pool, lambda x: x <= z)) / len(pool)::DOUBLE FROM nq),
own AS (SELECT index_id, opos FROM both4 WHERE model = 'spread' AND quant IS NOT NULL),
on_own AS (SELECT both4.* FROM both4 JOIN own USING (index_id, opos))"""


def _macro_question(f: DataFrame, names: tuple[str, ...]) -> DataFrame:
    both = kept(_with_spread(f, names))
    own = both.where("model = 'spread' AND quant IS NOT NULL").select("index_id", "opos")
    return shown(scores.calibration(both.join(own, ["index_id", "opos"], "left_semi"), ["index_id", "model"]), f"index_id model {CAL}")


def _with_spread(f: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return fhs(f, YEAR, names).unionByName(dist.simulated(_log_variance(f), YEAR))


@query(sql(BASE, walk_sql(), VOL_SQL, fhs_sql(), _LOGVAR, _WITH_SPREAD, calibration_sql("on_own", "index_id, model")) + f" SELECT {_CAL_SQL} FROM cm")
def k12_macro_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a financial-conditions series set the width better? All models on the series' own window."""
    return _macro_question(panel(spark, sf_dir), ("const", "ewma", "vix"))


@query()
def k12_macro_question_garch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _macro_question(with_variances(features(spark, sf_dir), ("const", "garch")), ("const", "garch"))


@query()
def k30_predictive_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of every origin under constant, weighted, GARCH and macro-driven variances."""
    f = with_variances(features(spark, sf_dir), ("const", "ewma", "garch"))
    q = levels(_with_spread(f, ("const", "ewma", "garch")).where("quant IS NOT NULL"))
    return shown(q, "index_id model date mu realized sigma pit opos q05 q25 q50 q75 q95")


@query()
def k31_common_window_garch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and common windows of the models with a long history."""
    f = with_variances(features(spark, sf_dir), ("const", "ewma", "garch"))
    rows = kept(fhs(f, YEAR, ("const", "ewma", "garch")))
    own, common = (scores.calibration(x, ["index_id", "model"]).withColumn("window", F.lit(n)) for n, x in (("own", rows), ("common", common_window(rows))))
    return shown(own.unionByName(common), f"index_id model window {CAL}")


@query()
def k11_implied_against_garch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every horizon, implied variance against GARCH at the origins where both have a distribution; a tie is GARCH's."""
    f = with_variances(features(spark, sf_dir), ("garch", "vix"))

    def one(h: walk.Horizon) -> DataFrame:
        c = scores.calibration(common_window(fhs(f, h, ("garch", "vix"))), ["index_id", "model"]).where("n >= 24")
        of = lambda model, x: F.max(F.when(F.col("model") == model, F.col(x)))
        a = c.groupBy("index_id").agg(F.max("n").alias("n"), *[of(m, x).alias(f"{m}_{x}") for m in ("garch", "vix") for x in ("pinball", "cover_90")])
        return a.withColumn("winner", F.when(F.col("garch_pinball") <= F.col("vix_pinball"), "garch").otherwise("vix"))

    return shown(over_horizons(_KEYS, one), "horizon index_id n garch_pinball vix_pinball garch_cover_90 vix_cover_90 winner")


@query()
def d20_block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fhs(panel(spark, sf_dir)).where("quant IS NOT NULL")
    inside = (F.col("realized") >= F.get("quant", F.lit(0))) & (F.col("realized") <= F.get("quant", F.lit(18)))
    return shown(scores.block_bootstrap(rows, inside, ["index_id", "model"], "opos", YEAR.steps), "index_id model lo hi")


# Live forecasts and decisions. The leaf: a series' last row with everything that a fan needs.

BOND = 0.04


def leaf(spark: SparkSession, sf_dir: str, h=YEAR, model: str = "ewma") -> DataFrame:
    f = kept(with_variances(features(spark, sf_dir), (model,)))
    return leaf_of(f, h, model)


def leaf_of(f: DataFrame, h=YEAR, model: str = "ewma") -> DataFrame:
    v = variances(f, (model,))
    rows = dist.level_calibrated(dist.residuals(walk.walk(f, h), v, h), h)
    return walk.live(f, h).join(dist.live_sigma(rows, v, h), "index_id").join(dist.pool_quantiles(rows), ["index_id", "model"]).withColumns({"y": F.lit(BOND), "years": F.lit(h.years)})


def live_ctes(h=YEAR, k: str = "") -> str:
    """CTEs that end in lf{k}, from og{k}_b and fh{k}: the leaf of weighted variances."""
    return f"""lv{k} AS (SELECT index_id, sum(CASE WHEN ok THEN gap * (fwd - g * {h.years!r}) END) / sum(CASE WHEN ok THEN gap * gap END) AS lam_ols, arg_max(g, pos) * {h.years!r} AS growth, arg_max(gap, pos) AS gap, exp(arg_max(log_p, pos)) AS p0, max(date) AS asof_date FROM og{k}_b GROUP BY 1),
ll{k} AS (SELECT *, greatest(0.0, least({h.cap!r}, {h.shrink!r} * lam_ols + {1 - h.shrink!r} * {h.prior!r})) AS lam_used FROM lv{k}),
cs{k} AS (SELECT index_id, arg_max(cape, pos) AS cape, arg_max(cape_star, pos) AS cape_star FROM ft GROUP BY 1),
sg{k} AS (SELECT index_id, sqrt(avg(CASE WHEN raw IS NOT NULL THEN resid * resid END) / avg(raw * raw)) AS k, quantile_cont(z, [0.01, 0.025]) AS zt, quantile_cont(z, {GRID_SQL}) AS z, count(z) AS pool FROM fh{k} WHERE model = 'ewma' GROUP BY 1),
sv{k} AS (SELECT index_id, arg_max(v, pos) AS v FROM ew WHERE v IS NOT NULL GROUP BY 1),
lf{k} AS (SELECT index_id, lam_ols, lam_used, growth, lam_used * gap AS valuation, growth + lam_used * gap AS mu, p0, asof_date, cape, cape_star, k, k * sqrt({h.steps} * v) AS sigma, z, zt, pool FROM ll{k} JOIN cs{k} USING (index_id) JOIN sg{k} USING (index_id) JOIN sv{k} USING (index_id))"""


LEAF = sql(BASE, walk_sql(), VOL_SQL, fhs_sql(), live_ctes())


@query(LEAF + " SELECT " + picked("index_id asof_date", "lam_ols lam_used growth valuation mu sigma k p0 cape cape_star", "pool") + ", round(exp(mu) - 1, 6) AS annual FROM lf")
def k04_live_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = leaf(spark, sf_dir).withColumns({"asof_date": F.col("asof"), "annual": F.exp(F.col("mu") / F.col("years")) - 1})
    return shown(x, "index_id asof_date lam_ols lam_used growth valuation mu sigma k p0 cape cape_star pool annual")


_LIVE_COLUMNS = "lam_ols lam_used growth valuation mu sigma k p0"


@query(sql(BASE, VOL_SQL, *[c for k in _KEYS for c in (walk_sql(horizon(k), name=f"og{k}"), fhs_sql(horizon(k), og=f"og{k}", name=f"fh{k}"), live_ctes(horizon(k), k))])
    + " UNION ALL ".join(" SELECT " + picked("index_id asof_date", _LIVE_COLUMNS, "pool") + f", round(exp(mu / {horizon(k).years!r}) - 1, 6) AS annual, '{k}' AS horizon, '{horizon(k).tier}' AS tier FROM lf{k}" for k in _KEYS))
def k04_live_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live forecast of every horizon, with its tier."""
    f = kept(with_variances(features(spark, sf_dir), ("ewma",)))
    one = lambda h: leaf_of(f, h).withColumns({"asof_date": F.col("asof"), "annual": F.exp(F.col("mu") / F.col("years")) - 1, "tier": F.lit(h.tier)})
    return shown(over_horizons(_KEYS, one), f"index_id asof_date {_LIVE_COLUMNS} pool annual horizon tier")


_NEUTRAL = f"""nw_a AS (SELECT index_id, date, pos, log_p, r, lead(log_p, 6) OVER (PARTITION BY index_id ORDER BY pos) - log_p AS realized FROM ft),
nw_b AS (SELECT *, CASE WHEN count(realized) OVER w >= 120 THEN avg(realized) OVER w END AS fc FROM nw_a WINDOW w AS (PARTITION BY index_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING)),
nw AS (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY pos) - 1 AS opos FROM nw_b WHERE realized IS NOT NULL AND fc IS NOT NULL)"""


@query(sql(BASE, VOL_SQL, _NEUTRAL, fhs_sql(horizon("6mo"), og="nw", mu="fc", name="fh"), calibration_sql("(SELECT * FROM fh WHERE index_id = 'side')", "index_id, model")) + f" SELECT {_CAL_SQL}, cover_90 BETWEEN 0.86 AND 0.94 AS passed FROM cm")
def k26_second_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second index, which has no anchor: the mean outcome so far as its centre, the same widths, its calibration and gate."""
    f, h = panel(spark, sf_dir), horizon("6mo")
    f = f.where("index_id = 'side'")
    rows = dist.simulated(dist.level_calibrated(dist.residuals(walk.neutral_walk(f, h), variances(f), h, "mu"), h), h)
    return shown(scores.enforce(scores.gate(scores.calibration(rows, ["index_id", "model"]))), f"index_id model {CAL} passed")


@query(LEAF + ", bt AS (SELECT index_id, 1 AS version, '12mo' AS horizon, p0 AS spot, p0, mu, sigma FROM lf UNION ALL SELECT index_id, 2, '12mo', p0, p0, mu, sigma FROM lf) SELECT " + picked("version index_id horizon", "spot p0 mu sigma").replace("version", "version::BIGINT AS version") + " FROM bt")
def b17_both_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves read back from documents of the older and the newer schema."""
    x = with_horizon(leaf(spark, sf_dir), YEAR)
    new = leaves_of(document.forecast_document(x)).withColumn("version", F.lit(2))
    old = leaves_of(document.older_document(x).withColumnRenamed("index_id", "of"), index="").withColumn("index_id", F.col("of")).drop("of").withColumn("version", F.lit(1))
    return shown(old.unionByName(new), "version index_id horizon spot p0 mu sigma")


@query(LEAF + """, nw AS (SELECT index_id, arg_max(100 * d / p, pos) AS dividend, arg_max(100 * rate, pos) AS bond, arg_max(100 * spread, pos) AS cash FROM ft GROUP BY 1),
    al AS (SELECT *, 100 * (exp(mu) - 1) AS equity_price FROM lf JOIN nw USING (index_id))""" + " SELECT " + picked("index_id", "equity_price dividend bond cash") + ", round(equity_price + dividend, 6) AS equity_total, round(equity_price + dividend - bond, 6) AS premium FROM al")
def k09_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = panel(spark, sf_dir)
    return shown(walk.alternatives(walk.live(f), f), "index_id equity_price dividend bond cash equity_total premium")


_FAN = "CROSS JOIN generate_series(1, 12) s(step)"


def fan_sql(mu: str = "mu", p0: str = "p0", sigma: str = "sigma") -> str:
    return ", ".join(f"round({p0} * exp({mu} * step / 12 + {sigma} * z[{i + 1}] * sqrt(step / 12.0::DOUBLE)), 4) AS {n}" for n, i in _LEVELS)


def fan_shown(df: DataFrame, keys: str) -> DataFrame:
    return df.select(*keys.split(), F.col("step").cast("long").alias("step"), *[F.round(n, 4).alias(n) for n, _ in _LEVELS])


def interp_sql(x: str) -> str:
    """P(price below x) with levels p (19 prices) of the row."""
    g = "(0.05 * {i})"
    i = f"len(list_filter(p, lambda v: v <= {x}))"
    return f"(CASE WHEN {x} <= p[1] THEN 0.05 WHEN {x} >= p[19] THEN 0.95 ELSE {g.format(i=i)} + ({x} - p[{i}]) / (p[{i} + 1] - p[{i}]) * 0.05 END)"


@query(LEAF + f" SELECT index_id, step::BIGINT AS step, {fan_sql()} FROM lf {_FAN}")
def k02_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fan_shown(dist.fan(leaf(spark, sf_dir), 12), "index_id")


@query(LEAF + f" SELECT index_id, step::BIGINT AS step, {fan_sql()} FROM lf {_FAN}")
def k02_fan_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from SQL: a table function, joined laterally."""
    register(spark)
    return fan_shown(spark.sql("SELECT index_id, f.* FROM {leaf} AS x, LATERAL fan(x.p0, x.mu, x.sigma, x.z, 12) AS f", leaf=leaf(spark, sf_dir)), "index_id")


@query(LEAF + f""" SELECT index_id, round(1 - {interp_sql('p0')}, 6) AS p_up, round({interp_sql('(0.8 * p0)')}, 6) AS p_bear, round({normal_sql('(mu / sigma)')}, 6) AS p_up_normal, round(mu - lam_used * ln(1.1::DOUBLE), 6) AS mu_higher, round(greatest(-0.05::DOUBLE, least(0.05::DOUBLE, mu)), 6) AS mu_held
    FROM (SELECT *, list_transform(z, lambda v: p0 * exp(mu + sigma * v)) AS p FROM lf)""")
def k20_chances_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances and re-anchored forecasts from SQL alone, by the functions that the library registers."""
    register(spark)
    out = spark.sql("""SELECT index_id, 1 - probability_below(p0, prices) AS p_up, probability_below(0.8D * p0, prices) AS p_bear, normal_cdf(mu / sigma) AS p_up_normal, re_anchored(mu, lam_used, p0, 1.1D * p0) AS mu_higher, clipped(mu, -0.05D, 0.05D) AS mu_held
        FROM (SELECT *, transform(z, v -> p0 * exp(mu + sigma * v)) AS prices FROM {leaf})""", leaf=leaf(spark, sf_dir))  # fmt: skip
    return shown(out, "index_id p_up p_bear p_up_normal mu_higher mu_held")


@query(LEAF + f" SELECT index_id, step::BIGINT AS step, {', '.join(f'round(100 * (exp(mu * step / 12 + sigma * z[{i + 1}] * sqrt(step / 12.0::DOUBLE)) - 1), 6) AS {n}' for n, i in _LEVELS)} FROM lf {_FAN}")
def k23_market_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(dist.fan(leaf(spark, sf_dir), 12).withColumns({n: 100 * (F.col(n) / F.col("p0") - 1) for n, _ in _LEVELS}), "index_id step q05 q25 q50 q75 q95")


@query(LEAF + """ SELECT index_id, move, round(mu - CASE WHEN move <> 1 THEN lam_used * ln(move) ELSE 0 END, 6) AS mu_live, round(p0 * move * exp(mu - lam_used * ln(move) + sigma * z[10]), 4) AS median, round(p0 * move * exp(mu - lam_used * ln(move) + sigma * z[1]), 4) AS low FROM lf CROSS JOIN (VALUES (0.9::DOUBLE), (1.0::DOUBLE), (1.25::DOUBLE)) m(move)""")
def k03_re_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = leaf(spark, sf_dir).withColumn("move", F.explode(F.array(F.lit(0.9), F.lit(1.0), F.lit(1.25))))
    x = dist.re_anchored(x, F.col("p0") * F.col("move"))
    return x.select("index_id", "move", F.round("mu_live", 6).alias("mu_live"), F.round("price_q50", 4).alias("median"), F.round("price_q05", 4).alias("low"))


@query(LEAF + f""" SELECT index_id, round(exp(mu + sigma * z[1]) - 1, 6) AS var5, round((exp(mu + sigma * zt[1]) + exp(mu + sigma * zt[2]) + exp(mu + sigma * z[1])) / 3 - 1, 6) AS es, round(1 - {interp_sql('p0')}, 6) AS p_up, round(1 - {interp_sql('(1.1 * p0)')}, 6) AS p_up10,
    round({interp_sql('(0.9 * p0)')}, 6) AS p_down10, round({interp_sql('(0.8 * p0)')}, 6) AS p_bear, round({interp_sql(f'(p0 * exp({BOND}::DOUBLE))')}, 6) AS p_under_bond FROM (SELECT *, list_transform(z, lambda v: p0 * exp(mu + sigma * v)) AS p FROM lf)""")
def k20_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(dist.risk(leaf(spark, sf_dir)), "index_id var5 es p_up p_up10 p_down10 p_bear p_under_bond")


@query(LEAF + f" SELECT index_id, factor, step::BIGINT AS step, {fan_sql('(growth + lam_used * (ln(cape_star) - ln(cape * factor)))', '(p0 * 0.95::DOUBLE)', '(sigma * 1.5::DOUBLE)')} FROM lf CROSS JOIN (VALUES (0.8::DOUBLE), (1.0::DOUBLE), (1.2::DOUBLE)) c(factor) {_FAN}")
def k21_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = leaf(spark, sf_dir).withColumn("factor", F.explode(F.array(F.lit(0.8), F.lit(1.0), F.lit(1.2))))
    return fan_shown(dist.fan(dist.scenario(x, F.col("cape") * F.col("factor"), F.lit(1.5), F.lit(-0.05)), 12), "index_id factor")


def history(rows: DataFrame) -> DataFrame:
    """The first scored origin of each year in prices, with what came."""
    first = F.row_number().over(Window.partitionBy("index_id", "model", F.year("date")).orderBy("date"))
    h = levels(rows.where("quant IS NOT NULL").withColumn("first", first).where("first = 1"))
    p0 = F.exp("log_p")
    h = h.withColumns({"spot": p0, "realized_price": p0 * F.exp("realized"), "realized_pct": 100 * (F.exp("realized") - 1), "in90": (F.col("realized") >= F.col("q05")) & (F.col("realized") <= F.col("q95"))})
    return h.withColumns({f"price_{n}": p0 * F.exp(n) for n, _ in _LEVELS})


_HIST = "hi AS (SELECT *, row_number() OVER (PARTITION BY index_id, model, year(date) ORDER BY date) AS first FROM fh WHERE quant IS NOT NULL)"


@query(sql(BASE, walk_sql(), VOL_SQL, fhs_sql(), _HIST) + " SELECT index_id, model, date, round(exp(log_p), 4) AS spot, " + ", ".join(f"round(exp(log_p + quant[{i + 1}]), 4) AS price_{n}" for n, i in _LEVELS) + ", round(exp(log_p + realized), 4) AS realized_price, round(100 * (exp(realized) - 1), 6) AS realized_pct, realized >= quant[1] AND realized <= quant[19] AS in90 FROM hi WHERE first = 1")
def k05_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(fhs(panel(spark, sf_dir)))
    return h.select("index_id", "model", "date", F.round("spot", 4).alias("spot"), *[F.round(f"price_{n}", 4).alias(f"price_{n}") for n, _ in _LEVELS], F.round("realized_price", 4).alias("realized_price"), F.round("realized_pct", 6).alias("realized_pct"), "in90")


@query(sql(BASE, walk_sql(), VOL_SQL, fhs_sql(), _HIST) + " SELECT index_id, model, round(avg(CASE WHEN realized >= quant[1] AND realized <= quant[19] THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*)::BIGINT AS n FROM hi WHERE first = 1 GROUP BY 1, 2")
def d24_history_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(fhs(panel(spark, sf_dir))).groupBy("index_id", "model").agg(scores.hit(F.col("in90")).alias("hit_rate"), F.count(F.lit(1)).alias("n"))
    return shown(h, "index_id model hit_rate n")


@query(sql(BASE, walk_sql(), VOL_SQL, fhs_sql(), _HIST) + " SELECT index_id, model, date, step::BIGINT AS step, " + ", ".join(f"round(exp(log_p) + (exp(log_p + quant[{i + 1}]) - exp(log_p)) * sqrt(step / 12.0::DOUBLE), 4) AS {n}" for n, i in _LEVELS) + " FROM hi CROSS JOIN generate_series(0, 12) s(step) WHERE first = 1")
def k22_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fan_shown(dist.cone(history(fhs(panel(spark, sf_dir))), 12), "index_id model date")


CASES = {"main": (("1997-06-30", "rise"), ("1999-01-15", "turn"), ("2001-01-31", "late")), "side": (("1998-02-28", "rise"), ("2000-03-31", "peak"), ("2001-04-30", "trough"))}
_CASES_SQL = ", ".join(f"('{k}', DATE '{d}', '{n}')" for k, xs in CASES.items() for d, n in xs)


@query(sql(BASE, walk_sql(), VOL_SQL, fhs_sql(), f"t(index_id, target, label) AS (VALUES {_CASES_SQL})", "ca AS (SELECT index_id, label, arg_min(date, (abs(date - target), date)) AS date, arg_min(quant, (abs(date - target), date)) AS quant, arg_min(realized, (abs(date - target), date)) AS realized FROM t JOIN (SELECT * FROM fh WHERE model = 'ewma' AND quant IS NOT NULL) USING (index_id) GROUP BY 1, 2)") + " SELECT index_id, label, date, round(quant[10], 6) AS median, round(realized, 6) AS realized, realized >= quant[1] AND realized <= quant[19] AS in90 FROM ca")
def k06_case_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was forecast at turning points of each index, and what came."""
    rows = kept(levels(fhs(panel(spark, sf_dir), YEAR, ("ewma",)).where("quant IS NOT NULL")).select("index_id", "date", "realized", "q05", "q50", "q95"))
    out = None
    for index_id, days in CASES.items():
        one = series.nearest(rows.where(F.col("index_id") == index_id), days)
        out = one if out is None else out.unionByName(one)
    c = out.withColumns({"median": F.col("q50"), "in90": (F.col("realized") >= F.col("q05")) & (F.col("realized") <= F.col("q95"))})
    return shown(c, "index_id label date median realized in90")


@query(LEAF + " SELECT index_id, " + "printf('%s: %.0f, %+.1f%% (%.0f to %.0f)', index_id, p0, 100 * (exp(mu + sigma * z[10]) - 1), p0 * exp(mu + sigma * z[1]), p0 * exp(mu + sigma * z[19])) AS line FROM lf")
def k32_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = leaf(spark, sf_dir)
    price = lambda i: F.col("p0") * F.exp(F.col("mu") + F.col("sigma") * F.get("z", F.lit(i)))
    return x.select("index_id", F.format_string("%s: %.0f, %+.1f%% (%.0f to %.0f)", "index_id", "p0", 100 * (price(9) / F.col("p0") - 1), price(0), price(18)).alias("line"))


def with_horizon(leaves: DataFrame, h: walk.Horizon) -> DataFrame:
    return leaves.withColumns({"horizon": F.lit(h.key), "horizon_months": F.lit(h.steps), "tier": F.lit(h.tier)})


def all_leaves(f: DataFrame) -> DataFrame:
    return over_horizons(_KEYS, lambda h: with_horizon(leaf_of(f, h), h).drop("horizon"))


@query()
def a14_forecast_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole document: both indices, nine horizons, each with its leaf, quantiles, fan path and calibration, and the indicators."""
    f = kept(with_variances(features(spark, sf_dir), ("ewma",)))
    cal = over_horizons(_KEYS, lambda h: scores.calibration(fhs(f, h, ("ewma",)), ["index_id"]))
    x = all_leaves(f).join(cal, ["index_id", "horizon"], "left")
    return document.forecast_document(x, feat.indicator_panel(f, INDICATORS), CAL.split())


_NINE = [c for k in _KEYS for c in (walk_sql(horizon(k), name=f"og{k}"), fhs_sql(horizon(k), og=f"og{k}", name=f"fh{k}"), live_ctes(horizon(k), k))]


@query(sql(BASE, VOL_SQL, *_NINE) + " UNION ALL ".join(" SELECT " + picked("index_id", "p0 mu sigma") + f", '{k}' AS horizon, round(p0, 6) AS spot FROM lf{k}" for k in _KEYS))
def a14_document_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document written to a file and read back: the leaves of both indices and all horizons."""
    f = kept(with_variances(features(spark, sf_dir), ("ewma",)))
    at = f"{shared_dir(spark)}/kept/{spark.sparkContext.applicationId}/document"
    document.forecast_document(all_leaves(f)).write.mode("overwrite").text(at)
    docs = spark.read.text(at).withColumnRenamed("value", "document")
    return shown(leaves_of(docs), "index_id horizon spot p0 mu sigma")


@query(sql(BASE, VOL_SQL, *_NINE) + " UNION ALL ".join(f" SELECT index_id, '{k}' AS horizon, round(100 * (exp(growth / {horizon(k).years!r}) - 1), 6) AS growth_pct, round(100 * (exp(mu / {horizon(k).years!r}) - exp(growth / {horizon(k).years!r})), 6) AS valuation_pct, round(100 * (exp(mu / {horizon(k).years!r}) - 1), 6) AS total_pct FROM lf{k}" for k in _KEYS))
def k07_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What growth and valuation add a year; a forecast whose parts don't add up to it fails the query."""
    f = kept(with_variances(features(spark, sf_dir), ("ewma",)))
    return shown(document.decomposed(all_leaves(f)), "index_id horizon growth_pct valuation_pct total_pct")


_LEAVES_SQL = "lz AS (" + " UNION ALL ".join(f"SELECT index_id, '{k}' AS horizon, {horizon(k).steps} AS steps, {horizon(k).years!r}::DOUBLE AS years, '{horizon(k).tier}' AS tier, p0, mu, sigma, z, pool FROM lf{k}" for k in _KEYS) + ")"
_PRICE = "p0 * exp(mu + sigma * z[{}])"
_PCT = "100 * (exp(mu + sigma * z[{}]) - 1)"


@query(sql(BASE, VOL_SQL, *_NINE, _LEAVES_SQL) + f""" SELECT index_id, horizon, CASE WHEN index_id = 'side' THEN 'neutral' WHEN tier = 'long-run' THEN 'long-run' ELSE 'plain' END AS variant,
    CASE WHEN index_id = 'side' THEN printf('%s %s, no anchor: %+.1f%% (%+.1f%% to %+.1f%%)', index_id, horizon, {_PCT.format(10)}, {_PCT.format(1)}, {_PCT.format(19)})
    WHEN tier = 'long-run' THEN printf('%s %s: %+.1f%% a year, %+.1f%% in all, from %d windows', index_id, horizon, 100 * (exp(mu / years) - 1), {_PCT.format(10)}, greatest(1, pool // steps)::BIGINT)
    ELSE printf('%s %s: %.0f to %.0f (%+.1f%%), 90%% %.0f to %.0f, 50%% %.0f to %.0f', index_id, horizon, p0, {_PRICE.format(10)}, {_PCT.format(10)}, {_PRICE.format(1)}, {_PRICE.format(19)}, {_PRICE.format(5)}, {_PRICE.format(15)}) END AS line FROM lz""")
def k32_headline_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of every index and horizon, worded by index and tier."""
    f = kept(with_variances(features(spark, sf_dir), ("ewma",)))
    return document.headline(all_leaves(f), F.col("index_id") == "side")


_COMPARED, _LEAST_WINDOWS = ("3mo", "36mo", "120mo"), 20


@query(sql(BASE, VOL_SQL, *_NINE, _LEAVES_SQL, f"""hv AS (SELECT * FROM lz WHERE pool // steps >= {_LEAST_WINDOWS}), al AS (SELECT horizon FROM hv GROUP BY 1 HAVING count(DISTINCT index_id) = (SELECT count(DISTINCT index_id) FROM hv)),
    ak AS (SELECT asked, CASE WHEN asked IN (SELECT horizon FROM al) THEN asked ELSE '12mo' END AS horizon FROM (VALUES {', '.join(f"('{k}')" for k in _COMPARED)}) v(asked))""")
    + f" SELECT asked, horizon, index_id, step::BIGINT AS step, {', '.join(f'round(100 * (exp(mu * step / steps + sigma * z[{i + 1}] * sqrt(step / steps::DOUBLE)) - 1), 6) AS {n}' for n, i in _LEVELS)} FROM ak JOIN hv USING (horizon) CROSS JOIN LATERAL (SELECT unnest(generate_series(1, steps)) AS step) s")
def k23_common_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both markets' fans in per cent of spot at the asked horizon where both have one resting on enough windows, else at twelve months."""
    f = kept(with_variances(features(spark, sf_dir), ("ewma",)))
    x = kept(all_leaves(f).where(F.floor(F.col("pool") / F.col("horizon_months")) >= _LEAST_WINDOWS))
    asked = x.agg(F.explode(F.array(*map(F.lit, _COMPARED))).alias("asked"))
    out = dist.fan(document.common_horizon(x, asked).join(x, "horizon"), F.col("horizon_months"))
    return shown(out.withColumns({n: 100 * (F.col(n) / F.col("p0") - 1) for n, _ in _LEVELS}), "asked horizon index_id step q05 q25 q50 q75 q95")


_SIDE_CASES = (("1998-02-28", "rise"), ("2000-03-31", "peak"), ("2001-04-30", "trough"))
_SIDE_H = horizon("6mo")


def _parts_sql(source: str, names: str, part: str, of: str, where: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{part}' AS part, {of} AS item, '{n}' AS name, round({n}, 6) AS value FROM {source} {where}" for n in names.split())


@query(sql(BASE, _TWO_SQL, _NEUTRAL, fhs_sql(_SIDE_H, og="nw", mu="fc", name="fh"),
    "sd AS (SELECT * FROM fh WHERE index_id = 'side' AND model = 'ewma')",
    """tr AS (SELECT index_id, pos, log_p, count(log_p) OVER w = 240 AS filled, regr_slope(log_p, pos) OVER w AS b, regr_intercept(log_p, pos) OVER w AS a FROM ft WHERE index_id = 'side' WINDOW w AS (PARTITION BY index_id ORDER BY pos ROWS BETWEEN 239 PRECEDING AND CURRENT ROW)),
    tf AS (SELECT arg_max(a + b * pos, pos) AS trend, 12 * arg_max(b, pos) AS trend_growth, arg_max(a + b * pos - log_p, pos) AS trend_gap FROM tr WHERE filled)""",
    f"""le AS (SELECT (SELECT avg(realized) FROM nw_a WHERE index_id = 'side') AS mu, (SELECT exp(arg_max(log_p, pos)) FROM ft WHERE index_id = 'side') AS p0, sqrt(avg(CASE WHEN raw IS NOT NULL THEN resid * resid END) / avg(raw * raw)) * sqrt({_SIDE_H.steps} * (SELECT arg_max(v, pos) FROM ew WHERE index_id = 'side' AND v IS NOT NULL)) AS sigma FROM sd)""",
    """hs AS (SELECT *, quant[1] AS q05, quant[10] AS q50, quant[19] AS q95 FROM (SELECT *, row_number() OVER (PARTITION BY year(date) ORDER BY date) AS first FROM sd WHERE quant IS NOT NULL) WHERE first = 1)""",
    f"""cs AS (SELECT label, arg_min(realized, (abs(date - target), date)) AS realized, arg_min(quant, (abs(date - target), date))[10] AS q50 FROM (VALUES {', '.join(f"(DATE '{d}', '{n}')" for d, n in _SIDE_CASES)}) t(target, label) CROSS JOIN (SELECT * FROM sd WHERE quant IS NOT NULL) GROUP BY 1)""")
    + " " + " UNION ALL ".join([_parts_sql("tf", "trend trend_growth trend_gap", "feature", "'now'"), _parts_sql("le", "mu p0 sigma", "leaf", "'6mo'"), _parts_sql("hs", "realized q05 q50 q95", "history", "date::VARCHAR"), _parts_sql("cs", "realized q50", "case", "label")]))
def k26_second_index_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is shown of the second index, a row per part, item and name: trend features instead of an anchor, the leaf around the mean outcome, history and cases."""
    h = _SIDE_H
    f = kept(with_variances(features(spark, sf_dir), ("ewma",)).where("index_id = 'side'"))
    v = variances(f, ("ewma",))
    rows = kept(levels(dist.simulated(dist.level_calibrated(dist.residuals(walk.neutral_walk(f, h), v, h, "mu"), h), h)))
    trend = feat.rolling_trend(f).where("trend IS NOT NULL").groupBy("index_id").agg(*[F.max_by(c, "pos").alias(c) for c in ("trend", "trend_growth", "trend_gap")])
    now = walk.neutral_live(f, h).join(dist.live_sigma(rows, v, h), "index_id")
    known = rows.where("quant IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("index_id", F.year("date")).orderBy("date"))
    past = known.withColumn("_f", first).where("_f = 1")
    cases = series.nearest(known.select("date", "realized", "q50"), _SIDE_CASES)

    def part(df: DataFrame, name: str, item, names: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names.split()]))
        return df.select(F.lit(name).alias("part"), item.alias("item"), each.alias("x")).select("part", "item", "x.*")

    out = part(trend, "feature", F.lit("now"), "trend trend_growth trend_gap").unionByName(part(now, "leaf", F.lit(h.key), "mu p0 sigma"))
    out = out.unionByName(part(past, "history", F.col("date").cast("string"), "realized q05 q50 q95")).unionByName(part(cases, "case", F.col("label"), "realized q50"))
    return shown(out, "part item name value")
