"""Predictive distributions by filtered historical simulation, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import GRID, NORMAL_GRID, T5_GRID, interpolate, normal_cdf, t5_cdf
from .blocks import haloed, scanned
from .blocks import own as own_rows
from .order import expanding
from .walk import Horizon
from .windows import done

SERIES = ("index_id", "model")
FAN = {"q05": 0, "q25": 4, "q50": 9, "q75": 14, "q95": 18}


def grid() -> Column:
    return F.array(*[F.lit(q) for q in GRID])


def residuals(origins: DataFrame, variances: DataFrame, h: Horizon, mu: str = "fc_level0_est") -> DataFrame:
    """A row per origin and model: mu, realized, resid and the raw deviation over the horizon; dealt by series and model.

    The number of parts is given, as these few rows cost much work each and would otherwise be put together in one task.
    """
    o = origins.select("index_id", "date", F.col("pos").cast("long").alias("pos"), "opos", "log_p", F.col(mu).alias("mu"), "realized", (F.col("realized") - F.col(mu)).alias("resid"))
    rows = o.join(variances, ["index_id", "pos"], "left").withColumn("raw", F.sqrt(h.steps * F.col("v"))).drop("v")
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *SERIES)


def level_calibrated(rows: DataFrame, h: Horizon, blocks: int | None = None) -> DataFrame:
    """sigma: the raw deviation times the ratio of residuals to raw deviations among completed origins. blocks: rows of a task's block of a long series."""
    known, square = F.col("raw").isNotNull(), lambda c: F.col(c) * F.col(c)
    one = F.lit(1).cast("long")
    f = rows if blocks is None else haloed(rows, blocks, before=h.steps, pos="opos")
    f = scanned(f, {"_n": F.when(F.col("mu").isNotNull(), one), "_k": F.when(known, one), "_e": F.when(known, square("resid")), "_r": square("raw"), "_ne": F.when(known & F.col("resid").isNotNull(), one)}, h.steps, blocks, "opos", SERIES)
    k = F.sqrt((F.col("_e") / F.col("_ne")) / (F.col("_r") / F.col("_k")))
    enough = (F.col("_n") >= h.min_cal) & (F.col("_k") >= h.min_cal) & known
    f = f.withColumn("sigma", F.when(enough, k * F.col("raw"))).withColumn("z", F.when(F.col("sigma") > 0, F.col("resid") / F.col("sigma"))).drop("_n", "_k", "_e", "_r", "_ne")
    return f if blocks is None else own_rows(f)


def log_variance(rows: DataFrame, driver: str, h: Horizon) -> DataFrame:
    """sigma from an expanding regression of the log squared residual on one driver, held within 0.3 to 3 times the residuals' size."""
    w = done(h.steps, "opos", SERIES)
    y = F.ln(F.greatest(F.col("resid") * F.col("resid"), F.lit(1e-6)))
    f = rows.withColumn("y", F.when(F.col(driver).isNotNull(), y))
    fit = F.regr_intercept("y", driver).over(w) + F.regr_slope("y", driver).over(w) * F.col(driver)
    size = F.sqrt(F.avg(F.col("resid") * F.col("resid")).over(w))
    s = F.sqrt(F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), fit))))
    ok = (F.count("mu").over(w) >= h.min_cal) & (F.count("y").over(w) >= h.min_cal) & F.col(driver).isNotNull()
    f = f.withColumn("sigma", F.when(ok, F.greatest(0.3 * size, F.least(3 * size, s)))).drop("y")
    return f.withColumn("z", F.when(F.col("sigma") > 0, F.col("resid") / F.col("sigma")))


_POOLS = {"_s": ("z", "_std"), "_h": ("resid", "resid")}


def _pooled(rows: DataFrame, h: Horizon, pools: str, blocks: int | None = None) -> DataFrame:
    """rows with quantiles, rank and size of the pools of completed origins: s, of standardized residuals; h, of plain ones."""
    f = rows.withColumn("_std", F.try_divide("resid", "sigma")) if "s" in pools else rows
    return expanding(f, {f"_{p}": _POOLS[f"_{p}"] for p in pools}, h.steps, SERIES, "opos", GRID, blocks)


def _from_pool(f: DataFrame, h: Horizon, pool: str) -> DataFrame:
    """quant and pit by one of the pools."""
    ready = F.col(f"_{pool}_n") >= h.min_cal
    ready = ready & F.col("sigma").isNotNull() if pool == "s" else ready
    level = (lambda x: F.col("mu") + F.col("sigma") * x) if pool == "s" else (lambda x: F.col("mu") + x)
    return f.withColumns({"quant": F.when(ready, F.transform(f"_{pool}_q", level)), "pit": F.when(ready, F.col(f"_{pool}_below"))})


def _without_pools(f: DataFrame) -> DataFrame:
    return f.drop("_std", *[f"_{p}_{x}" for p in "sh" for x in ("q", "below", "n")])


def simulated(rows: DataFrame, h: Horizon, blocks: int | None = None) -> DataFrame:
    """quant (the 19 levels of GRID) and pit from the standardized residuals of completed origins.

    blocks: rows of a task's block of a long series, whose opos has no gaps.
    """
    return _without_pools(_from_pool(_pooled(rows, h, "s", blocks), h, "s"))


def historical(rows: DataFrame, h: Horizon, blocks: int | None = None) -> DataFrame:
    """As simulated(), from plain residuals."""
    return _without_pools(_from_pool(_pooled(rows, h, "h", blocks), h, "h"))


def parametric(rows: DataFrame, shape: str) -> DataFrame:
    """gaussian, or student_t (5 degrees, variance 1), around mu with deviation sigma."""
    std = F.col("resid") / F.col("sigma")
    values, cdf = (NORMAL_GRID, normal_cdf(std)) if shape == "gaussian" else (T5_GRID, t5_cdf(std / (3 / 5) ** 0.5))
    known = F.col("sigma").isNotNull()
    return rows.withColumns({"quant": F.when(known, F.array(*[F.col("mu") + F.col("sigma") * F.lit(v) for v in values])), "pit": F.when(known, cdf)})


def shapes(rows: DataFrame, h: Horizon, own: str = "fhs") -> DataFrame:
    """rows of one variance model under four shapes (model: own, gaussian, student_t, historical) at the origins that have the first.

    All are columns of one pass over the series, then a row each.
    """
    f, held = _pooled(rows, h, "sh"), {}
    for name, make in {own: lambda x: _from_pool(x, h, "s"), "gaussian": lambda x: parametric(x, "gaussian"), "student_t": lambda x: parametric(x, "student_t"), "historical": lambda x: _from_pool(x, h, "h")}.items():
        f = make(f)
        held[name] = F.struct(F.lit(name).alias("model"), F.col("quant").alias("quant"), F.col("pit").alias("pit"))
        f = f.withColumn(f"_{name}", held[name])
    each = F.explode(F.array(*[F.col(f"_{n}") for n in held])).alias("_x")
    keep = [c for c in rows.columns if c != "model"]
    return f.where(F.col(f"_{own}")["quant"].isNotNull()).select(*keep, each).select(*keep, "_x.*")


def recent_sigma(rows: DataFrame, last: int = 12) -> DataFrame:
    """Per series and model the median of its last calibrated deviations: for a model that has no variance of the last period."""
    w = Window.partitionBy(*SERIES).orderBy(F.desc("opos"))
    back = rows.where("sigma IS NOT NULL").withColumn("_back", F.row_number().over(w))
    return back.where(F.col("_back") <= last).groupBy(*SERIES).agg(F.median("sigma").alias("sigma"), F.count(F.lit(1)).alias("of"))


def pool_quantiles(rows: DataFrame) -> DataFrame:
    """Per series and model, over all standardized residuals: z (19 levels), z01 and z025, and the number of them."""
    return rows.groupBy(*SERIES).agg(F.percentile("z", grid()).alias("z"), F.percentile("z", F.lit(0.01)).alias("z01"), F.percentile("z", F.lit(0.025)).alias("z025"), F.count("z").alias("pool"))


def live_sigma(rows: DataFrame, variances: DataFrame, h: Horizon) -> DataFrame:
    """Per series and model the deviation at the series' last row, level-calibrated over all origins."""
    known = F.when(F.col("raw").isNotNull(), F.col("resid") * F.col("resid"))
    k = rows.groupBy(*SERIES).agg(F.sqrt(F.avg(known) / F.avg(F.col("raw") * F.col("raw"))).alias("k"))
    last = variances.groupBy(*SERIES).agg(F.max_by("v", "pos").alias("v"))
    return k.join(last, list(SERIES)).select(*SERIES, "k", (F.col("k") * F.sqrt(h.steps * F.col("v"))).alias("sigma"))


def fan(leaf: DataFrame, steps: Column | int, mu: str = "mu", sigma: str = "sigma", z: str = "z", p0: str = "p0") -> DataFrame:
    """A row per leaf and step k of 1..steps: prices at five levels, p0 * exp(mu * k / H + sigma * z * sqrt(k / H))."""
    h = F.lit(steps) if isinstance(steps, int) else steps
    at = F.col("step") / h
    price = lambda i: F.col(p0) * F.exp(F.col(mu) * at + F.col(sigma) * F.get(z, F.lit(i)) * F.sqrt(at))
    return leaf.withColumn("step", F.explode(F.sequence(F.lit(1), h))).withColumns({n: price(i) for n, i in FAN.items()})


def re_anchored(leaf: DataFrame, spot: Column, least_move: float = 1e-6) -> DataFrame:
    """leaf (mu, sigma, z, p0, lam_used) at a new price: the valuation part gives back lam_used of the move; unmoved rows stay."""
    moved = F.col("z").isNotNull() & (F.abs(spot / F.col("p0") - 1) > least_move)
    mu = F.when(moved, F.col("mu") - F.col("lam_used") * F.ln(spot / F.col("p0"))).otherwise(F.col("mu"))
    out = leaf.withColumns({"mu_live": mu, "spot": F.when(moved, spot).otherwise(F.col("p0"))})
    level = lambda i: F.col("spot") * F.exp(F.col("mu_live") + F.col("sigma") * F.get("z", F.lit(i)))
    return out.withColumns({f"price_{n}": level(i) for n, i in FAN.items()})


def probability_below(x: Column, prices: Column) -> Column:
    """The chance that the price ends below x, linear between levels and held at 0.05 and 0.95."""
    return interpolate(x, prices, grid())


def risk(leaf: DataFrame) -> DataFrame:
    """leaf (mu, sigma, z, z01, z025, p0, bond yield y, years) with value at risk, expected shortfall and three chances."""
    ret = lambda z: F.exp(F.col("mu") + F.col("sigma") * z) - 1
    prices = F.transform("z", lambda v: F.col("p0") * F.exp(F.col("mu") + F.col("sigma") * v))
    below = lambda x: probability_below(x, prices)
    z05 = F.get("z", F.lit(0))
    return leaf.withColumns({
        "var5": ret(z05), "es": (ret(F.col("z01")) + ret(F.col("z025")) + ret(z05)) / 3,
        "p_up": 1 - below(F.col("p0")), "p_up10": 1 - below(1.1 * F.col("p0")), "p_down10": below(0.9 * F.col("p0")), "p_bear": below(0.8 * F.col("p0")),
        "p_under_bond": below(F.col("p0") * F.exp(F.col("y") * F.col("years"))),
    })


def cone(history: DataFrame, steps: int, spot: str = "spot") -> DataFrame:
    """history (spot and end prices price_q05 .. price_q95) a row per step 0..steps: from spot to each end by the root of the step's share."""
    share = F.sqrt(F.col("step") / steps)
    end = {n: F.coalesce(f"price_{n}", f"price_{wide}") for n, wide in zip(FAN, ("q05", "q05", "q50", "q95", "q95"))}
    return history.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumns({n: F.col(spot) + (e - F.col(spot)) * share for n, e in end.items()})


def scenario(leaf: DataFrame, cape: Column, sigma_times: Column, shock: Column) -> DataFrame:
    """leaf at another valuation, deviation and price."""
    mu = F.col("growth") + F.col("lam_used") * (F.ln("cape_star") - F.ln(cape))
    return leaf.withColumns({"mu": mu, "sigma": F.col("sigma") * sigma_times, "p0": F.col("p0") * (1 + shock)})
