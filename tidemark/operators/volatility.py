"""Per-period variances: constant, exponentially weighted, GARCH(1,1) with Student's t, implied.

Each adds a column v_<name> to a frame of returns; all but GARCH are windows over one sort by series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import ordered, whole

#: Decay, least rows, rows of the constant variance, rows between refits.
DECAY, MIN_HISTORY, TRAIL, REFIT = 0.94, 240, 600, 12
#: Returns that a block holds; powers of the decay over a block stay far inside a double, and what lies two blocks back weighs less than its last digit.
BLOCK = 600


def with_returns(features: DataFrame) -> DataFrame:
    return features.withColumn("r", F.col("log_p") - F.lag("log_p").over(ordered()))


def constant(returns: DataFrame) -> DataFrame:
    w = ordered().rowsBetween(-TRAIL, 0)
    return returns.withColumn("v_const", F.when(F.count("r").over(w) >= MIN_HISTORY, F.var_samp("r").over(w)))


def ewma(returns: DataFrame, decay: float = DECAY) -> DataFrame:
    """v_ewma at n returns: decay^n * seed + (1 - decay) * sum of decay^(n - k) * r_k^2.

    The sum runs over the row's own block and the one before it; so a window sum does the recursion, for series of any length.
    """
    seed = F.var_pop(F.when(F.col("pos") < MIN_HISTORY, F.col("r"))).over(whole())
    f = returns.withColumns({"_k": F.count("r").over(ordered()), "_seed": seed})
    f = f.withColumn("_block", F.floor(F.col("_k") / BLOCK))
    power = lambda n: F.pow(F.lit(decay), n)
    f = f.withColumn("_u", F.coalesce(F.col("r") * F.col("r") * power(F.col("_block") * BLOCK - F.col("_k")), F.lit(0.0)))
    own = F.sum("_u").over(ordered(keys=("index_id", "_block")))
    before = F.coalesce(F.sum("_u").over(Window.partitionBy("index_id").orderBy("_block").rangeBetween(-1, -1)), F.lit(0.0))
    since = F.col("_k") - F.col("_block") * BLOCK
    v = power(F.col("_k")) * F.col("_seed") + (1 - decay) * (power(since) * own + power(since + BLOCK) * before)
    return f.withColumn("v_ewma", F.when(F.col("pos") >= MIN_HISTORY, v)).drop("_k", "_seed", "_block", "_u")


def implied(returns: DataFrame, level: str) -> DataFrame:
    return returns.withColumn("v_vix", F.pow(F.col(level) / 100, F.lit(2.0)) / 12)


def variance_paths(r: np.ndarray, omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray, start: float) -> np.ndarray:
    """A row per parameter set: h[t] = omega + alpha * r[t-1]^2 + beta * h[t-1], h[0] = start; r has a row per set.

    Blocks of 32 steps are one product, carried from block to block.
    """
    sets, n = r.shape
    size = 32
    u = np.empty((sets, n + (-n) % size))
    u[:, 0], u[:, 1:n], u[:, n:] = start, omega[:, None] + alpha[:, None] * r[:, :-1] ** 2, 0.0
    u = u.reshape(sets, -1, size)
    k = np.arange(size)
    powers = beta[:, None] ** np.arange(size + 1)
    lower = np.where(k[:, None] >= k, powers[:, np.maximum(k[:, None] - k, 0)], 0.0)
    inside = u @ lower.transpose(0, 2, 1)
    carry = np.zeros(sets)
    for i in range(inside.shape[1]):
        inside[:, i] += carry[:, None] * powers[:, 1:]
        carry = inside[:, i, -1]
    return inside.reshape(sets, -1)[:, :n]


def _natural(x: np.ndarray, var: float) -> tuple[np.ndarray, ...]:
    """mu, omega, alpha, beta, nu of rows of free numbers: alpha + beta is below 1 by form."""
    x = np.clip(x, -25, 25)
    lasting, share = 0.9999 / (1 + np.exp(-x[:, 2])), 1 / (1 + np.exp(-x[:, 3]))
    return x[:, 0] * math.sqrt(var), var * np.exp(x[:, 1]), lasting * share, lasting * (1 - share), 2.05 + np.exp(np.minimum(x[:, 4], 6))


def loss(x: np.ndarray, r: np.ndarray, var: float) -> np.ndarray:
    """The mean negative log likelihood of returns under rows of free numbers."""
    mu, omega, alpha, beta, nu = _natural(x, var)
    e = r[None, :] - mu[:, None]
    h = np.maximum(variance_paths(e, omega, alpha, beta, var), 1e-12)
    const = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(math.pi * (v - 2)) for v in nu])
    return -const + (0.5 * np.log(h) + (nu[:, None] + 1) / 2 * np.log1p(e * e / (h * (nu[:, None] - 2)))).mean(axis=1)


def fit_garch(r: np.ndarray, most: int = 200) -> tuple[float, float, float, float]:
    """omega, alpha, beta and the last conditional variance of returns in percent, by a quasi-Newton descent.

    Slopes and line searches are tried side by side, a row of free numbers each.
    """
    var = float(np.var(r)) if len(r) > 1 else 0.0
    if not var > 0:
        raise ValueError("returns don't vary")
    x = np.array([r.mean() / math.sqrt(var), math.log(0.05), 3.0, -2.5, math.log(6.0)])
    d, lengths = len(x), 0.3 ** np.arange(8)
    shifts = 1e-5 * np.vstack([np.eye(d), -np.eye(d)])

    def slope(at: np.ndarray) -> np.ndarray:
        f = loss(at + shifts, r, var)
        return (f[:d] - f[d:]) / 2e-5

    value, g, inverse = loss(x[None, :], r, var)[0], slope(x), np.eye(d)
    for _ in range(most):
        way = -inverse @ g
        way *= min(1.0, 3.0 / max(1e-12, np.abs(way).max()))
        tried = loss(x + lengths[:, None] * way, r, var)
        good = np.flatnonzero(tried <= value + 1e-4 * lengths * (g @ way))
        if g @ way >= 0 or not len(good):
            if (inverse == np.eye(d)).all():
                break
            inverse = np.eye(d)
            continue
        step, gain = lengths[good[0]] * way, value - tried[good[0]]
        x, value, before = x + step, tried[good[0]], g
        g = slope(x)
        if np.abs(g).max() < 1e-6 or gain < 1e-11 * (1 + abs(value)):
            break
        y = g - before
        if (sy := step @ y) > 1e-12:
            side = np.eye(d) - np.outer(step, y) / sy
            inverse = side @ inverse @ side.T + np.outer(step, step) / sy
    mu, omega, alpha, beta, _ = (p[0] for p in _natural(x[None, :], var))
    last = variance_paths((r - mu)[None, :], np.array([omega]), np.array([alpha]), np.array([beta]), var)[0, -1]
    return float(omega), float(alpha), float(beta), float(last)


FITS = "index_id string, at long, omega double, alpha double, beta double, last double"


def garch_fits(returns: DataFrame, refit: int = REFIT) -> DataFrame:
    """index_id, at, omega, alpha, beta, last: a fit on all returns known at each refit row; null where a fit fails.

    A series goes once to each of as many groups as there are task slots, twice over; a group fits at every so many-th refit row, so its work is like the
    others', and one long series uses the whole cluster.
    """
    groups = returns.sparkSession.sparkContext.defaultParallelism * 2
    series = returns.groupBy("index_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "r"))).alias("rows"), F.max("pos").cast("long").alias("end"))
    jobs = series.where(F.col("end") >= MIN_HISTORY).select("index_id", "rows", "end", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    jobs = jobs.repartition(groups, "group", "index_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for jobs in batches:
            out = []
            for index_id, rows, end, group in zip(jobs["index_id"], jobs["rows"], jobs["end"], jobs["group"]):
                pos, r = np.array([x["pos"] for x in rows]), np.array([np.nan if x["r"] is None else x["r"] for x in rows], dtype=float) * 100
                refits = [t for t in range(MIN_HISTORY, end + 1) if t == MIN_HISTORY or t % refit == 0]
                for at in refits[group::groups]:
                    known = r[: np.searchsorted(pos, at, "right")]
                    try:
                        omega, alpha, beta, last = fit_garch(known[~np.isnan(known)])
                        found = (omega / 1e4, alpha, beta, last / 1e4) if np.isfinite([omega, alpha, beta, last]).all() else (None,) * 4
                    except ValueError:
                        found = (None,) * 4
                    out.append((index_id, at, *found))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FITS.split(", ")])

    return jobs.mapInPandas(run, FITS)


def targeted_fits(returns: DataFrame, alpha: float = 0.05, beta: float = 0.9, refit: int = REFIT) -> DataFrame:
    """As garch_fits, without a search: alpha and beta are given, and omega makes the long-run variance that of all returns known at the refit row, where the
    recursion starts again. Null where these don't vary. One window a series, no Python.
    """
    pos, every = F.col("pos"), Window.partitionBy("index_id").orderBy("pos")
    known = returns.withColumn("_var", F.var_pop("r").over(every)).where((pos >= MIN_HISTORY) & ((pos == MIN_HISTORY) | (pos % refit == 0)))
    v = F.when(F.col("_var") > 0, F.col("_var"))
    given = [F.when(v.isNotNull(), F.lit(x)).alias(n) for n, x in (("alpha", alpha), ("beta", beta))]
    return known.select("index_id", pos.cast("long").alias("at"), (v * (1 - alpha - beta)).alias("omega"), *given, v.alias("last"))


def garch(returns: DataFrame, refit: int = REFIT, fits: DataFrame | None = None) -> DataFrame:
    """v_garch, the variance of the period after each row, and v_garch_failed, how many fits have failed by then.

    From a refit on, variances follow the fit's recursion from the fit's own last variance. A failed fit leaves the one before in
    force; before the first fit the variance of the first returns stands.
    """
    fits = garch_fits(returns, refit) if fits is None else fits
    f = returns.withColumn("_pos", F.col("pos").cast("long")).join(fits.withColumnsRenamed({"index_id": "_id", "at": "_at"}), (F.col("index_id") == F.col("_id")) & (F.col("_pos") == F.col("_at")), "left")
    o = ordered()
    fit = F.when(F.col("omega").isNotNull(), F.struct("_at", "omega", "alpha", "beta", "last"))
    f = f.withColumns({
        "_fit": F.last(fit, ignorenulls=True).over(o), "v_garch_failed": F.count(F.when(F.col("_at").isNotNull() & F.col("omega").isNull(), 1)).over(o),
        "_seed": F.var_pop(F.when(F.col("pos") < MIN_HISTORY, F.col("r"))).over(whole()),
    })
    # A fit is in force for the rows up to the next: their squares are all that the recursion needs.
    squares = F.collect_list(F.col("r") * F.col("r")).over(Window.partitionBy("index_id", F.col("_fit")["_at"]).orderBy("pos"))
    p = F.col("_fit")
    v = F.aggregate(squares, p["last"], lambda h, x: p["omega"] + p["alpha"] * x + p["beta"] * h)
    f = f.withColumn("v_garch", F.when(F.col("pos") >= MIN_HISTORY, F.when(p.isNotNull(), v).otherwise(F.col("_seed"))))
    return f.drop("_pos", "_id", "_at", "omega", "alpha", "beta", "last", "_fit", "_seed")


def unpivoted(rows: DataFrame, names: tuple[str, ...], keep: tuple[str, ...] = ("index_id", "pos")) -> DataFrame:
    """keep, model and v of the columns v_<name>: a row per row and name."""
    x = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"v_{n}").alias("v")) for n in names]))
    return rows.select(*keep, x.alias("_x")).select(*keep, "_x.*").withColumn("pos", F.col("pos").cast("long"))
