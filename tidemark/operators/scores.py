"""Scores of point and distribution forecasts, tests that allow for overlapping windows, and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import GRID, normal_cdf

#: Lags of the errors' correction, levels that bands lie between, and the share that a 90 per cent band may cover.
HAC_LAGS = 18
COVER = {"50": (4, 14), "80": (1, 17), "90": (0, 18)}
GATE = (0.86, 0.94)


def r2(realized: Column, fc: Column, bench: Column, when: Column | None = None) -> Column:
    """1 - SSE / SSE of the benchmark."""
    on = (lambda x: F.when(when, x)) if when is not None else (lambda x: x)
    return 1 - F.try_divide(F.sum(on((realized - fc) * (realized - fc))), F.sum(on((realized - bench) * (realized - bench))))


def policy_metrics(long: DataFrame) -> DataFrame:
    """Per series and policy: n, rmse, mae, mean error, R2 against zero and against the historical mean, window."""
    e, r, f = F.col("realized") - F.col("fc"), F.col("realized"), F.col("fc")
    return long.groupBy("index_id", "policy").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("mean_error"),
        r2(r, f, F.lit(0.0)).alias("r2_zero"), r2(r, f, F.col("fc_rw_drift")).alias("r2_drift"), F.min("date").alias("first"), F.max("date").alias("last"),
    )


def hit(x: Column) -> Column:
    """The share of true; unknown counts as a miss."""
    return F.avg(F.when(x, 1.0).otherwise(0.0))


def direction_hit(fc: Column, realized: Column) -> Column:
    return F.avg((F.signum(fc) == F.signum(realized)).cast("double"))


def hac(rows: DataFrame, x: Column, y: Column, keys: Sequence[str], order: str, lags: int = HAC_LAGS) -> DataFrame:
    """Least squares of y on x through the origin with Newey-West errors: n, beta, t, r2 (uncentred). x = 1: a mean and its t.

    Residuals times regressor are multiplied with their own lags inside each series' sort.
    """
    w, every = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    f = rows.select(*keys, order, x.alias("_x"), y.alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    f = f.withColumn("_b", F.sum(F.col("_x") * F.col("_y")).over(every) / F.sum(F.col("_x") * F.col("_x")).over(every))
    f = f.withColumn("_e", F.col("_y") - F.col("_b") * F.col("_x")).withColumn("_s", F.col("_x") * F.col("_e"))
    products = F.col("_s") * F.col("_s")
    for k in range(1, lags + 1):
        products = products + 2 * (1 - k / (lags + 1)) * F.col("_s") * F.coalesce(F.lag("_s", k).over(w), F.lit(0.0))
    f = f.withColumn("_p", products)
    a = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("_b").alias("beta"), F.sum("_p").alias("_p"), F.sum(F.col("_x") * F.col("_x")).alias("_xx"), F.sum(F.col("_e") * F.col("_e")).alias("_ee"), F.sum(F.col("_y") * F.col("_y")).alias("_yy"))
    return a.select(*keys, "n", "beta", F.try_divide(F.col("beta") * F.col("_xx"), F.sqrt("_p")).alias("t"), (1 - F.try_divide("_ee", "_yy")).alias("r2"))


def clark_west(rows: DataFrame, realized: Column, small: Column, large: Column, keys: Sequence[str], order: str, lags: int = HAC_LAGS) -> DataFrame:
    """Whether the large model beats the small one: t, half the two-sided p, and the one-sided p."""
    adjusted = (realized - small) * (realized - small) - ((realized - large) * (realized - large) - (small - large) * (small - large))
    t = hac(rows, F.lit(1.0), adjusted, keys, order, lags)
    return t.select(*keys, "n", F.col("t").alias("cw_t"), (1 - normal_cdf(F.abs("t"))).alias("cw_p_halved"), (1 - normal_cdf(F.col("t"))).alias("cw_p_onesided"))


def pinball(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and level the mean pinball loss of the quantiles in quant."""
    levels = F.array(*[F.lit(q) for q in GRID])
    x = rows.where("quant IS NOT NULL").select(*keys, "realized", F.explode(F.arrays_zip(levels.alias("a"), F.col("quant").alias("q"))).alias("x"))
    d = F.col("realized") - F.col("x.q")
    return x.groupBy(*keys, F.col("x.a").alias("level")).agg(F.avg(F.greatest(F.col("x.a") * d, (F.col("x.a") - 1) * d)).alias("loss"))


def mean_pinball(quant: Column, realized: Column) -> Column:
    """A row's pinball loss over all levels, as an expression."""
    levels = F.array(*[F.lit(q) for q in GRID])
    losses = F.zip_with(levels, quant, lambda a, q: F.greatest(a * (realized - q), (a - 1) * (realized - q)))
    return F.aggregate(losses, F.lit(0.0), lambda s, x: s + x) / len(GRID)


def finite(quant: Column) -> Column:
    return quant.isNotNull() & F.forall(quant, lambda q: q.isNotNull() & ~F.isnan(q) & (F.abs(q) < float("inf")))


def calibration(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: n, pinball, KS distance of pit from uniform, coverage and width at 50, 80 and 90 per cent."""
    f = rows.where(finite(F.col("quant")))
    w, every = Window.partitionBy(*keys).orderBy("pit"), Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.asc_nulls_last("pit")))
    f = f.withColumns({"_i": rank, "_n": F.count("pit").over(every)})
    ks = F.max(F.greatest(F.col("_i") / F.col("_n") - F.col("pit"), F.col("pit") - (F.col("_i") - 1) / F.col("_n")))
    q = lambda i: F.get("quant", F.lit(i))
    return f.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(mean_pinball(F.col("quant"), F.col("realized"))).alias("pinball"), ks.alias("pit_ks"),
        *[hit((F.col("realized") >= q(a)) & (F.col("realized") <= q(b))).alias(f"cover_{n}") for n, (a, b) in COVER.items()],
        *[F.avg(q(b) - q(a)).alias(f"width_{n}") for n, (a, b) in COVER.items()],
    )


def calibration_by_window(rows: DataFrame, keys: Sequence[str], common: str) -> DataFrame:
    """calibration() of all rows (window: own) and of those where the flag `common` is true (window: common), as two grouping sets of one pass."""
    f = rows.where(finite(F.col("quant")))
    names = {"own": list(keys), "common": [*keys, common]}
    for n, by in names.items():
        w = Window.partitionBy(*by)
        i, of = F.row_number().over(w.orderBy(F.asc_nulls_last("pit"))), F.count("pit").over(w)
        f = f.withColumn(f"_ks_{n}", F.greatest(i / of - F.col("pit"), F.col("pit") - (i - 1) / of))
    q = lambda i: F.get("quant", F.lit(i))
    f = f.withColumns({"_loss": mean_pinball(F.col("quant"), F.col("realized")), **{f"_in_{n}": ((F.col("realized") >= q(a)) & (F.col("realized") <= q(b))).cast("int") for n, (a, b) in COVER.items()}, **{f"_w_{n}": q(b) - q(a) for n, (a, b) in COVER.items()}})
    a = f.groupingSets([[F.col(c) for c in by] for by in names.values()], *[F.col(c) for c in names["common"]]).agg(
        F.grouping(common).alias("_every"), F.count(F.lit(1)).alias("n"), F.avg("_loss").alias("pinball"), *[F.max(f"_ks_{n}").alias(f"_ks_{n}") for n in names],
        *[F.avg(f"_in_{n}").alias(f"cover_{n}") for n in COVER], *[F.avg(f"_w_{n}").alias(f"width_{n}") for n in COVER],
    )
    every = F.col("_every") == 1
    a = a.where(every | F.col(common)).withColumns({"window": F.when(every, "own").otherwise("common"), "pit_ks": F.when(every, F.col("_ks_own")).otherwise(F.col("_ks_common"))})
    return a.drop("_every", "_ks_own", "_ks_common", common)


def metrics_by_sets(long: DataFrame, since: int) -> DataFrame:
    """R2 against both benchmarks by policy and era (all rows, and the years from `since` on), by policy over all series, and by series over all policies: grouping sets of one pass."""
    r, f = F.col("realized"), F.col("fc")
    x = long.withColumn("late", F.year("date") >= since)
    by = ("index_id", "policy", "late")
    sets = [("index_id", "policy", "late"), ("index_id", "policy"), ("policy",), ("index_id",), ()]
    a = x.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by]).agg(
        F.grouping_id(*by).alias("_set"), F.count(F.lit(1)).alias("n"), r2(r, f, F.col("fc_rw_drift")).alias("r2_mean"), r2(r, f, F.col("fc_drift_only")).alias("r2_drift_only")
    )
    whole = F.lit("all")
    a = a.where((F.col("_set") != 0) | F.col("late"))
    return a.select(F.coalesce("index_id", whole).alias("index_id"), F.coalesce("policy", whole).alias("policy"), F.when(F.col("late"), "late").otherwise("all").alias("era"), "n", "r2_mean", "r2_drift_only")


def pit_histogram(rows: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Counts in equal bins of 0..1, the last one closed, empty bins included."""
    counted = rows.where("pit IS NOT NULL").groupBy(*keys, F.least(F.width_bucket("pit", F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = counted.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return every.join(counted, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def effective(n: Column, steps: int) -> Column:
    return F.greatest(F.lit(1), F.floor(n / steps).cast("long"))


def block_bootstrap(rows: DataFrame, flag: Column, keys: Sequence[str], order: str, block: int, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """10 and 90 per cent of the coverage under a circular block bootstrap; a group is one series of flags."""
    flags = rows.select(*keys, order, flag.cast("double").alias("_f"))
    types = dict(rows.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        f = g.sort_values(order)["_f"].to_numpy()
        n, rng = len(f), np.random.default_rng(seed)
        blocks = -(-n // block)
        # A circular block's sum is a difference of running sums, so a repetition needs no index per row.
        twice = np.concatenate([[0.0], np.cumsum(np.concatenate([f, np.resize(f, block)]))])
        starts = np.stack([rng.integers(0, n, size=blocks) for _ in range(n_boot)])
        length = np.full(blocks, block)
        length[-1] = n - block * (blocks - 1)
        means = (twice[starts + length] - twice[starts]).sum(axis=1) / n if block <= n else np.full(n_boot, f.mean())
        row = {k: [g[k].iloc[0]] for k in keys}
        return pd.DataFrame({**row, "lo": [np.quantile(means, 0.1)], "hi": [np.quantile(means, 0.9)]})

    return flags.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", lo double, hi double")


def verdict(model: Column, r2_: Column, p: Column, reference: str = "hist_mean") -> Column:
    return F.when(model == reference, "reference").when((p < 0.05) & (r2_ > 0), "beats_mean").when(r2_ > 0, "tie").otherwise("loses_to_mean")


def point_leaderboard(forecasts: DataFrame, steps: int, since: int, least: int = 24, reference: str = "hist_mean") -> DataFrame:
    """forecasts (index_id, date, pos, model, fc, realized, bench) scored against bench; `since`: the year of the honest window."""
    f = forecasts.where("fc IS NOT NULL AND realized IS NOT NULL AND bench IS NOT NULL")
    r, x, b = F.col("realized"), F.col("fc"), F.col("bench")
    late = F.year("date") >= since
    keys = ["index_id", "model"]
    a = f.groupBy(*keys).agg(
        r2(r, x, b).alias("oos_r2"), F.when(F.count(F.when(late, 1)) >= least, r2(r, x, b, late)).alias("oos_r2_late"),
        direction_hit(x, r).alias("dir_hit"), F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"),
    ).where(F.col("n") >= least)
    cw = clark_west(f.where(F.col("model") != reference), r, b, x, keys, "pos").drop("n")
    a = a.join(cw, keys, "left")
    a = a.withColumns({"verdict": verdict(F.col("model"), F.col("oos_r2"), F.col("cw_p_halved"), reference), "n_eff": effective(F.col("n"), steps)})
    rank = F.row_number().over(Window.partitionBy("index_id").orderBy(F.desc_nulls_last("oos_r2"), "model"))
    return a.withColumn("rank", rank)


def distribution_leaderboard(calibrated: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("index_id").orderBy("pinball", "model"))
    return calibrated.withColumn("rank", rank).withColumn("verdict", F.when(F.col("rank") == 1, "best"))


def gate(calibrated: DataFrame, within: tuple[float, float] = GATE) -> DataFrame:
    """Whether each 90 per cent band covers about what it says."""
    return calibrated.withColumn("passed", F.col("cover_90").between(*within))


def enforce(gated: DataFrame, strict: bool = False) -> DataFrame:
    """gate()'s rows; with strict it fails where one hasn't passed."""
    if strict:
        failed = gated.where(~F.coalesce("passed", F.lit(False))).collect()
        if failed:
            raise ValueError("coverage outside the gate: " + "; ".join(f"{r.index_id} {r.model} {r.cover_90:.3f}" for r in failed))
    return gated


def headline(points: DataFrame, distributions: DataFrame, predictors: list[str]) -> DataFrame:
    """Per series: what valuation adds to drift (all, late), how many predictors beat the mean, and the best distribution."""
    of = lambda model, c: F.max(F.when(F.col("model") == model, F.col(c)))
    gain = lambda c: of("level0", c) - of("drift_only", c)
    beat = F.count(F.when(F.col("model").isin(predictors) & (F.col("verdict") == "beats_mean"), 1))
    p = points.groupBy("index_id").agg(gain("oos_r2").alias("increment"), gain("oos_r2_late").alias("increment_late"), beat.alias("beating"), of("level0", "n_eff").alias("n_eff"))
    best = distributions.where("rank = 1").select("index_id", F.col("model").alias("best_distribution"))
    return p.join(best, "index_id", "left").withColumn("predictors", F.lit(len(predictors)))
