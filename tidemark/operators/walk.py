"""Walk-forward point forecasts: every estimate at a row uses only rows whose outcome was known by then."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..sources.tables import kept
from .blocks import carried, fitted, haloed, own, paired, scanned, summed
from .features import BANDS
from .series import positioned
from .windows import SERIES, done, ordered

#: Fixed value: least completed rows.
MIN_TRAIN = 120
#: The policies' names.
POLICIES = ("level0_est", "level0_prior", "full_reversion", "drift_only", "rw_zero", "rw_drift")


@dataclass(frozen=True)
class Horizon:
    key: str
    steps: int
    prior: float
    cap: float
    shrink: float
    min_cal: int
    tier: str

    @property
    def years(self) -> float:
        return self.steps / 12


#: Horizon, steps, prior, cap, shrinkage, least calibration rows, tier.
HORIZONS = [
    Horizon("3mo", 3, 0.03, 0.20, 0.5, 120, "core"),
    Horizon("6mo", 6, 0.05, 0.25, 0.5, 120, "core"),
    Horizon("12mo", 12, 0.10, 0.35, 0.5, 120, "core"),
    Horizon("24mo", 24, 0.18, 0.45, 0.5, 120, "core"),
    Horizon("36mo", 36, 0.25, 0.55, 0.4, 96, "core"),
    Horizon("60mo", 60, 0.45, 0.80, 0.25, 60, "long-run"),
    Horizon("120mo", 120, 0.65, 1.0, 0.25, 48, "long-run"),
    Horizon("180mo", 180, 0.75, 1.0, 0.25, 40, "long-run"),
    Horizon("240mo", 240, 0.85, 1.0, 0.25, 36, "long-run"),
]
YEAR = HORIZONS[2]


def horizon(key: str) -> Horizon:
    return next(h for h in HORIZONS if h.key == key)


def completed(features: DataFrame, h: Horizon, lag: int = 0, keys: Sequence[str] = SERIES) -> DataFrame:
    """features with fwd (log return over the horizon), signals held back by `lag` rows (the price stays current), and ok: all three known."""
    o = ordered(keys=keys)
    held = {c: F.lag(c, lag).over(o) for c in ("g", "gap")} if lag else {}
    offsets = {f"off_q{round(b * 100):02d}": F.ln(f"q{round(b * 100):02d}") - F.ln("cape_star") for b in BANDS if f"q{round(b * 100):02d}" in features.columns}
    f = features.withColumns({**offsets, "fwd": F.lead("log_p", h.steps).over(o) - F.col("log_p"), **held})
    if lag:
        f = f.withColumns({c: F.lag(c, lag).over(o) for c in offsets})
    return f.withColumn("ok", F.col("fwd").isNotNull() & F.col("gap").isNotNull() & F.col("g").isNotNull())


def _completed_in_blocks(features: DataFrame, h: Horizon, lag: int, blocks: int) -> DataFrame:
    """completed(), dealt in blocks: with rows behind for the outcome, rows before for the totals and what their signals are held back by."""
    return completed(haloed(features, blocks, before=h.steps + lag, after=h.steps), h, lag, (*SERIES, "_block"))


def _lambda_terms(h: Horizon) -> dict[str, Column]:
    rest, ok = F.col("fwd") - F.col("g") * h.years, lambda x: F.when(F.col("ok"), x)
    return {"n_done": ok(F.lit(1).cast("long")), "_gr": ok(F.col("gap") * rest), "_gg": ok(F.col("gap") * F.col("gap")), "_fwd": ok(F.col("fwd"))}


def _with_lambda(f: DataFrame, h: Horizon) -> DataFrame:
    f = f.withColumns({"n_done": F.coalesce("n_done", F.lit(0).cast("long")), "lam_ols": F.try_divide("_gr", "_gg"), "hist_mean": F.try_divide("_fwd", "n_done")}).drop("_gr", "_gg", "_fwd")
    return f.withColumn("lam_used", clip(h.shrink * F.col("lam_ols") + (1 - h.shrink) * h.prior, 0.0, h.cap))


def expanding_lambda(features: DataFrame, h: Horizon, lag: int = 0, blocks: int | None = None) -> DataFrame:
    """n_done, lam_ols, lam_used and hist_mean over the completed rows: running sums, one pass.

    blocks: None for a series a task; else blocks of so many rows of a series of any length, with totals carried from block to block.
    """
    f = completed(features, h, lag) if blocks is None else _completed_in_blocks(features, h, lag, blocks)
    f = _with_lambda(scanned(f, _lambda_terms(h), h.steps, blocks), h)
    return f if blocks is None else own(f)


def walk(features: DataFrame, h: Horizon = YEAR, lag: int = 0, min_train: int = MIN_TRAIN, predictors: Mapping[str, Column] | None = None, blocks: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per origin: realized, lam_ols, lam_used, fc_<policy>, band_q.., and opos, the origin's own place.

    predictors: fc_<name> of a regression on each is added, from windows of the same sort. blocks: as of expanding_lambda(); all totals are of one deal.
    keep: columns of features that go along.
    """
    more = {f"fc_{n}": x for n, x in (predictors or {}).items()}
    if blocks is None:
        f = expanding_lambda(features, h, lag)
        f = f.withColumns({n: _regression(F.col("fwd"), x, h, min_train) for n, x in more.items()})
    else:
        terms = _lambda_terms(h)
        f = summed(_completed_in_blocks(features, h, lag, blocks), terms, h.steps, blocks)
        f = summed(f, {"_seen": F.when(F.col("ok"), F.lit(1).cast("long"))}, 0, blocks)
        f = paired(f, F.col("fwd"), more, h.steps, blocks) if more else f
        used = [c for c in f.columns if c.startswith(("off_q", "_")) or c in (*SERIES, "date", "pos", "log_p", "g", "gap", "fwd", "ok", *terms, *keep)]
        f = carried(kept(f.where("_own").select(*used)), [*terms, "_seen"], blocks)
        f = fitted(f, list(more), min_train, blocks) if more else f
        f = own(_with_lambda(f, h))
    f = f.where(F.col("ok") & (F.col("n_done") >= min_train))
    drift = F.col("g") * h.years
    point = {
        "level0_est": drift + F.col("lam_used") * F.col("gap"), "level0_prior": drift + h.prior * F.col("gap"), "full_reversion": drift + F.col("gap"),
        "drift_only": drift, "rw_zero": F.lit(0.0), "rw_drift": F.col("hist_mean"),
    }
    bands = [(point["level0_est"] + F.col("lam_used") * F.col(c)).alias("band" + c[3:]) for c in f.columns if c.startswith("off_q")]
    columns = ["index_id", "date", "pos", "log_p", "g", "gap", F.col("fwd").alias("realized"), "lam_ols", "lam_used", *[point[p].alias(f"fc_{p}") for p in POLICIES], *bands, *more, *keep]
    if blocks is None:
        return positioned(f.select(*columns), "pos", name="opos")
    # From the first origin on every completed row is one, as the number of those before only grows, so a running count of them is the place.
    first = kept(f.groupBy(*SERIES).agg(F.min("_seen").alias("_first")))
    return f.join(F.broadcast(first), list(SERIES)).select(*columns, (F.col("_seen") - F.col("_first")).alias("opos"))


def neutral_walk(features: DataFrame, h: Horizon, min_train: int = MIN_TRAIN) -> DataFrame:
    """Origins of a series without a valuation anchor: the forecast is the mean outcome so far."""
    f = features.withColumn("fwd", F.lead("log_p", h.steps).over(ordered()) - F.col("log_p"))
    w = done(h.steps)
    f = f.select("index_id", "date", "pos", "log_p", F.col("fwd").alias("realized"), F.when(F.count("fwd").over(w) >= min_train, F.avg("fwd").over(w)).alias("mu"))
    return positioned(f.where("realized IS NOT NULL AND mu IS NOT NULL"), "pos", name="opos")


def neutral_live(features: DataFrame, h: Horizon) -> DataFrame:
    """The forecast at each series' last row without an anchor: mu, the mean of all outcomes, and p0."""
    f = features.withColumn("fwd", F.lead("log_p", h.steps).over(ordered()) - F.col("log_p"))
    return f.groupBy("index_id").agg(F.avg("fwd").alias("mu"), F.exp(F.max_by("log_p", "pos")).alias("p0"))


def policies(origins: DataFrame) -> DataFrame:
    """index_id, date, pos, policy, fc, realized: a row per origin and policy."""
    x = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.col(f"fc_{p}").alias("fc")) for p in POLICIES]))
    return origins.select("index_id", "date", "pos", "realized", "fc_rw_drift", "fc_drift_only", *[c for c in origins.columns if c.startswith("band")], x.alias("x")).select("*", "x.*").drop("x")


def _regression(y: Column, x: Column, h: Horizon, min_train: int) -> Column:
    w = done(h.steps)
    enough = (F.regr_count(y, x).over(w) >= min_train) & x.isNotNull()
    return F.when(enough, F.regr_intercept(y, x).over(w) + F.regr_slope(y, x).over(w) * x)


def predictive_regressions(features: DataFrame, predictors: Mapping[str, Column], h: Horizon = YEAR, min_train: int = MIN_TRAIN, blocks: int | None = None) -> DataFrame:
    """index_id, pos and fc_<name>: least squares of completed outcomes on one predictor each, evaluated at the row; one sort for all. blocks: as of expanding_lambda()."""
    keys = SERIES if blocks is None else (*SERIES, "_block")
    f = features if blocks is None else haloed(features, blocks, before=h.steps, after=h.steps)
    f = f.withColumn("y", F.lead("log_p", h.steps).over(ordered(keys=keys)) - F.col("log_p"))
    if blocks is not None:
        more = {f"fc_{n}": x for n, x in predictors.items()}
        f = paired(f, F.col("y"), more, h.steps, blocks)
        f = kept(f.where("_own").select("index_id", "pos", *[c for c in f.columns if c.startswith("_")]))
        return fitted(f, list(more), min_train, blocks).select("index_id", "pos", *more)
    f = f.select("index_id", "pos", "y", *[x.alias(n) for n, x in predictors.items()])
    return f.select("index_id", "pos", *[_regression(F.col("y"), F.col(n), h, min_train).alias(f"fc_{n}") for n in predictors])


def kitchen_sink(features: DataFrame, predictors: Sequence[Column], h: Horizon = YEAR, min_train: int = MIN_TRAIN) -> DataFrame:
    """As predictive_regression with several predictors: moments are running sums, only the small solves are Python."""
    w, k = done(h.steps), len(predictors)
    f = features.select("index_id", "pos", (F.lead("log_p", h.steps).over(ordered()) - F.col("log_p")).alias("y"), *[p.alias(f"x{i}") for i, p in enumerate(predictors)])
    xs = [f"x{i}" for i in range(k)]
    known = F.lit(True)
    for x in xs:
        known = known & F.col(x).isNotNull()
    both = known & F.col("y").isNotNull()
    # Centred on the first known row of the series, so that moments keep their digits.
    first = [F.first(F.when(known, F.col(x)), ignorenulls=True).over(ordered()) for x in xs]
    f = f.withColumns({"known": known, "both": both, **{f"z{i}": F.col(x) - first[i] for i, x in enumerate(xs)}})
    z = [F.lit(1.0), *[F.col(f"z{i}") for i in range(k)]]
    total = lambda v: F.coalesce(F.sum(F.when(F.col("both"), v)).over(w), F.lit(0.0))
    xx = F.array(*[total(z[i] * z[j]) for i in range(k + 1) for j in range(k + 1)])
    xy = F.array(*[total(z[i] * F.col("y")) for i in range(k + 1)])
    f = f.select("index_id", "pos", "known", F.count(F.when(F.col("both"), 1)).over(w).alias("n"), xx.alias("xx"), xy.alias("xy"), F.array(*z).alias("z"))

    @F.pandas_udf("double")
    def solved(a: pd.Series, b: pd.Series, at: pd.Series) -> pd.Series:
        m, v, x = np.stack(a.to_list()).reshape(-1, k + 1, k + 1), np.stack(b.to_list()), np.stack(at.to_list())
        scale = np.sqrt(np.maximum(np.diagonal(m, axis1=1, axis2=2), 1e-300))
        m, v = m / scale[:, :, None] / scale[:, None, :], v / scale
        return pd.Series(((np.linalg.pinv(m, rcond=1e-13, hermitian=True) @ v[:, :, None])[:, :, 0] / scale * x).sum(axis=1))

    ready = f.where(F.col("known") & (F.col("n") >= min_train))
    return ready.select("index_id", "pos", solved("xx", "xy", "z").alias("fc"))


def live(features: DataFrame, h: Horizon = YEAR) -> DataFrame:
    """The forecast at each series' last row, from all completed rows: lam_used, mu, p0, asof, growth and valuation parts."""
    f = completed(features, h)
    rest = F.col("fwd") - F.col("g") * h.years
    ok = lambda x: F.sum(F.when(F.col("ok"), x))
    last = lambda c: F.max_by(c, "pos")
    a = f.groupBy("index_id").agg(
        F.try_divide(ok(F.col("gap") * rest), ok(F.col("gap") * F.col("gap"))).alias("lam_ols"),
        last("g").alias("g"), last("gap").alias("gap"), F.exp(last("log_p")).alias("p0"), last("date").alias("asof"),
        last("cape").alias("cape"), last("cape_star").alias("cape_star"),
    )
    lam = clip(h.shrink * F.col("lam_ols") + (1 - h.shrink) * h.prior, 0.0, h.cap)
    a = a.withColumn("lam_used", lam).withColumns({"growth": F.col("g") * h.years, "valuation": F.col("lam_used") * F.col("gap")})
    return a.withColumn("mu", F.col("growth") + F.col("valuation"))


def alternatives(live: DataFrame, features: DataFrame, h: Horizon = YEAR, bond: str = "rate", cash: str = "spread") -> DataFrame:
    """live() beside what else could be held, in percent a year: price and dividend return, bond, cash and the premium over the bond."""
    latest = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("pos")))
    now = features.groupBy("index_id").agg(latest(100 * F.try_divide("d", "p")).alias("dividend"), latest(100 * F.col(bond)).alias("bond"), latest(100 * F.col(cash)).alias("cash"))
    x = live.join(now, "index_id").withColumn("equity_price", 100 * (F.exp(F.col("mu") / h.years) - 1))
    return x.withColumn("equity_total", F.col("equity_price") + F.col("dividend")).withColumn("premium", F.col("equity_total") - F.col("bond"))
