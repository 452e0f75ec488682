"""Fits that have a closed form, so that SQL can check the whole walk: variances on a target, and an elastic net of one feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import macro, volatility
from .moving import macro_rows
from .panel import BASE, features, panel, sql, walk_sql
from .point import _MACRO
from .registry import query
from .shown import picked, shown

_ALPHA, _BETA = 0.05, 0.9
_AT = f"pos >= {volatility.MIN_HISTORY} AND (pos = {volatility.MIN_HISTORY} OR pos % {volatility.REFIT} = 0)"


@query(sql(BASE, f"""
tf AS (SELECT index_id, pos, r, var_pop(r) OVER o AS var, max(CASE WHEN {_AT} THEN pos END) OVER o AS made FROM ft WINDOW o AS (PARTITION BY index_id ORDER BY pos)),
tg AS (SELECT index_id, pos, max(CASE WHEN pos = made THEN var END) OVER (PARTITION BY index_id, made) AS target, list(r * r) OVER (PARTITION BY index_id, made ORDER BY pos) AS squares FROM tf WHERE made IS NOT NULL),
tv AS (SELECT index_id, pos, 0 AS failed, 1e6 * list_reduce(list_prepend(target, list_filter(squares, lambda x: x IS NOT NULL)), lambda h, x: {1 - _ALPHA - _BETA!r} * target + {_ALPHA!r} * x + {_BETA!r} * h) AS v FROM tg)""")
    + " SELECT " + picked("index_id", "v", "pos failed") + " FROM tv")
def e15_targeted_garch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variances (in millionths) between refits by the recursion of GARCH, whose long-run variance is that of the returns known at the refit."""
    f = features(spark, sf_dir)
    g = volatility.garch(f, fits=volatility.targeted_fits(f, _ALPHA, _BETA)).where("v_garch IS NOT NULL")
    return shown(g.withColumn("v", 1e6 * F.col("v_garch")).withColumnRenamed("v_garch_failed", "failed"), "index_id pos v failed")


_ONE = [("spread", "as_is", 1)]
_N, _SIZE = "n % 5", "n // 5"
_RATIOS = ", ".join(f"({k}, {r!r}::DOUBLE)" for k, r in enumerate(macro.RATIOS))
_LAST = macro.ALPHAS - 1


@query(sql(BASE, _MACRO, walk_sql(), f"""
kn AS (SELECT og.index_id, og.pos, spread_as_is AS x, realized - fc_level0_est AS y, row_number() OVER (PARTITION BY og.index_id ORDER BY og.pos) - 1 AS place FROM og JOIN mx USING (index_id, pos) WHERE spread_as_is IS NOT NULL),
rd AS (SELECT *, place // 12 AS refit FROM kn WHERE place - 11 >= {macro.MIN_TRAIN}),
sc AS (SELECT index_id, refit, min(place) AS made, min(place) - 11 AS n FROM rd GROUP BY 1, 2),
tr AS (SELECT sc.index_id, refit, x, y, CASE WHEN place < ({_N}) * ({_SIZE} + 1) THEN place // ({_SIZE} + 1) ELSE (place - ({_N}) * ({_SIZE} + 1)) // ({_SIZE}) + {_N} END AS fold FROM sc JOIN kn ON kn.index_id = sc.index_id AND place < n),
wh AS (SELECT index_id, refit, avg(x) AS m, stddev_pop(x) AS s, avg(y) AS level, covar_pop(x, y) / stddev_pop(x) AS c FROM tr GROUP BY 1, 2),
fo AS (SELECT index_id, refit, fold, c, count(*) AS n, sum((x - m) / s) AS z, sum(pow((x - m) / s, 2)) AS zz, sum((x - m) / s * y) AS zy, sum(y) AS y, sum(y * y) AS yy FROM tr JOIN wh USING (index_id, refit) GROUP BY 1, 2, 3, 4),
ot AS (SELECT *, sum(n) OVER w - n AS on_, (sum(z) OVER w - z) / (sum(n) OVER w - n) AS oz, (sum(zz) OVER w - zz) / (sum(n) OVER w - n) AS ozz, (sum(zy) OVER w - zy) / (sum(n) OVER w - n) AS ozy, (sum(y) OVER w - y) / (sum(n) OVER w - n) AS oy FROM fo WINDOW w AS (PARTITION BY index_id, refit)),
gr AS (SELECT k, ratio, i, pow({macro.DEPTH!r}, i / {_LAST}.0::DOUBLE) AS share FROM (VALUES {_RATIOS}) v(k, ratio) CROSS JOIN range({macro.ALPHAS}) t(i)),
ws AS (SELECT ot.*, k, ratio, i, share, sign(ozy - oz * oy) * greatest(abs(ozy - oz * oy) - abs(c) * share, 0) / (ozz - oz * oz + abs(c) * share * (1 - ratio) / ratio) AS w FROM ot CROSS JOIN gr),
ls AS (SELECT index_id, refit, k, ratio, i, share, avg((yy - 2 * w * zy - 2 * (oy - w * oz) * y + w * w * zz + 2 * (oy - w * oz) * w * z + n * pow(oy - w * oz, 2)) / n) AS loss FROM ws GROUP BY 1, 2, 3, 4, 5, 6),
bs AS (SELECT index_id, refit, arg_min(struct_pack(ratio := ratio, share := share), (loss, k, i)) AS b FROM ls GROUP BY 1, 2),
ft1 AS (SELECT index_id, refit, made, n AS trained, sign(c) * greatest(abs(c) - abs(c) * b.share, 0) / (1 + abs(c) * b.share * (1 - b.ratio) / b.ratio) / s AS coef, m, level FROM bs JOIN wh USING (index_id, refit) JOIN sc USING (index_id, refit)),
fc AS (SELECT index_id, pos, refit, made, trained, coef, level + coef * (x - m) AS fc FROM rd JOIN ft1 USING (index_id, refit))""")
    + " SELECT " + picked("index_id", "coef fc", "pos refit trained") + ", made::BIGINT AS at FROM fc")
def k16_one_feature_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one feature adds to the anchor: each forecast with the coefficient in force, whose penalty and mixing weight five folds choose anew every 12 rows."""
    names = [f"{c}_{k}" for c, k, _ in _ONE]
    got = macro.walk_forward(macro_rows(panel(spark, sf_dir), _ONE), names, "resid", 12)
    return shown(got.withColumn("coef", F.get("coef", F.lit(0))), "index_id coef fc pos refit at trained")
