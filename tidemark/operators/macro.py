"""Walk-forward elastic net on lagged macro features, from moments: a fit per refit, fits side by side."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Mixing weights that are tried; rows between refits, least training rows, folds, penalties a weight and the last's share of the first.
RATIOS = (0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 1.0)
REFIT, MIN_TRAIN, FOLDS, ALPHAS, DEPTH = 12, 180, 5, 100, 1e-3


class Moments:
    """Sums over rows: n, sums of x, of x x', of x y, of y and of y y. Sets of rows add and subtract."""

    def __init__(self, n: float, x: np.ndarray, xx: np.ndarray, xy: np.ndarray, y: float, yy: float):
        self.n, self.x, self.xx, self.xy, self.y, self.yy = n, x, xx, xy, y, yy

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Moments:
        return cls(len(y), x.sum(axis=0), x.T @ x, x.T @ y, y.sum(), y @ y)

    def __sub__(self, o: Moments) -> Moments:
        return Moments(self.n - o.n, self.x - o.x, self.xx - o.xx, self.xy - o.xy, self.y - o.y, self.yy - o.yy)

    def scaled(self, mean: np.ndarray, sd: np.ndarray) -> Moments:
        """Of (x - mean) / sd."""
        xx = self.xx - np.outer(mean, self.x) - np.outer(self.x, mean) + self.n * np.outer(mean, mean)
        return Moments(self.n, (self.x - self.n * mean) / sd, xx / np.outer(sd, sd), (self.xy - mean * self.y) / sd, self.y, self.yy)

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """Covariances of the features, and of the features with y."""
        m = self.x / self.n
        return self.xx / self.n - np.outer(m, m), self.xy / self.n - m * (self.y / self.n)

    def loss(self, w: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Mean squared errors of rows of coefficients with their levels."""
        sums = self.yy - 2 * w @ self.xy - 2 * level * self.y + np.einsum("ij,jk,ik->i", w, self.xx, w) + 2 * level * (w @ self.x) + self.n * level**2
        return sums / self.n


def descend(gram: np.ndarray, xy: np.ndarray, l1: np.ndarray, l2: np.ndarray, w: np.ndarray, most: int = 500, passes: int = 3) -> np.ndarray:
    """Elastic nets for several problems at once: gram (problems, k, k), xy and w (problems, k), penalties (problems).

    A few passes of coordinate descent propose which coefficients are zero and the others' signs; the equations of these are then
    solved, and a problem is done when its solution fits the proposal.
    """
    w, open_ = w.copy(), np.ones(len(w), dtype=bool)
    k = w.shape[1]
    eye, on = np.eye(k), np.einsum("pii->pi", gram)
    for _ in range(most):
        for _ in range(passes):
            for j in range(k):
                pull = xy[open_, j] - np.einsum("pi,pi->p", gram[open_, j], w[open_]) + on[open_, j] * w[open_, j]
                w[open_, j] = np.where(on[open_, j] > 0, np.sign(pull) * np.maximum(np.abs(pull) - l1[open_], 0.0) / np.maximum(on[open_, j] + l2[open_], 1e-300), 0.0)
        at, sign = np.flatnonzero(open_), np.sign(w[open_])
        used = sign != 0
        both = used[:, :, None] & used[:, None, :]
        left = np.where(both, gram[at] + (l2[at, None, None] + 1e-12) * eye, eye)
        exact = np.linalg.solve(left, np.where(used, xy[at] - l1[at, None] * sign, 0.0)[:, :, None])[:, :, 0]
        rest = np.abs(xy[at] - np.einsum("pij,pj->pi", gram[at], exact))
        fits = (np.where(used, np.sign(exact) == sign, rest <= l1[at, None] * (1 + 1e-9) + 1e-12)).all(axis=1)
        w[at[fits]] = exact[fits]
        open_[at[fits]] = False
        if not open_.any():
            break
    return w


def fit(prefixes: Sequence[Moments], ratios: Sequence[float] = RATIOS, n_alphas: int = ALPHAS) -> tuple[np.ndarray, float, float, float]:
    """Coefficients and level for raw features, penalty and mixing weight chosen over contiguous folds.

    prefixes: the moments of all rows before each fold's first row, and of all rows; the first is of none. Features are
    scaled on all rows; a fold's error is that of a fit on the others, all of a penalty's problems descending together from
    the penalty before.
    """
    whole = prefixes[-1]
    mean = whole.x / whole.n
    sd = np.sqrt(np.maximum(np.diag(whole.xx) / whole.n - mean**2, 0.0))
    sd = np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mean)), sd, 1.0)
    scaled = [p.scaled(mean, sd) for p in prefixes]
    whole = scaled[-1]
    folds = [b - a for a, b in zip(scaled, scaled[1:])]
    trains = [whole - f for f in folds]
    gram, xy = (np.stack(m) for m in zip(*(t.centred() for t in trains)))
    own_gram, own_xy = whole.centred()
    size, k = len(folds), len(mean)
    ratio = np.repeat(ratios, size)
    top = np.abs(own_xy).max() / ratio
    w = np.zeros((len(ratio), k))
    g, c = np.tile(gram, (len(ratios), 1, 1)), np.tile(xy, (len(ratios), 1))
    losses = np.empty((n_alphas, len(ratios)))
    for i, share in enumerate(np.geomspace(1, DEPTH, n_alphas)):
        alpha = top * share
        w = descend(g, c, alpha * ratio, alpha * (1 - ratio), w)
        error = np.zeros(len(ratios))
        for f, (fold, train) in enumerate(zip(folds, trains)):
            own = w[f::size]
            error += fold.loss(own, train.y / train.n - own @ (train.x / train.n))
        losses[i] = error / size
    r = int(np.argmin(losses.min(axis=0)))
    i = int(np.argmin(losses[:, r]))
    ratio, alpha = float(ratios[r]), float(np.abs(own_xy).max() / ratios[r] * np.geomspace(1, DEPTH, n_alphas)[i])
    w = descend(own_gram[None], own_xy[None], np.array([alpha * ratio]), np.array([alpha * (1 - ratio)]), np.zeros((1, k)))[0]
    return w / sd, float(whole.y / whole.n - whole.x @ w / whole.n - mean @ (w / sd)), alpha, ratio


FIT = "index_id string, refit long, at long, trained long, coef array<double>, level double, alpha double, ratio double"


def numbered(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """index_id, pos, _y, features and _at, the place among rows that have all features and the target."""
    w = Window.partitionBy("index_id").orderBy("pos")
    known = rows.select("index_id", "pos", F.col(target).alias("_y"), *features).dropna(subset=["_y", *features])
    return known.withColumn("_at", (F.row_number().over(w) - 1).cast("long"))


def schedule(known: DataFrame, steps: int, refit: int = REFIT, least: int = MIN_TRAIN) -> DataFrame:
    """index_id, refit, at and trained: the row of each refit and how many rows' outcomes were known there."""
    ready = known.where(F.col("_at") - steps + 1 >= least)
    s = ready.groupBy("index_id", F.floor(F.col("_at") / refit).cast("long").alias("refit")).agg(F.min("_at").alias("at"))
    return s.withColumn("trained", F.col("at") - steps + 1)


def refits(known: DataFrame, features: Sequence[str], steps: int, refit: int = REFIT, least: int = MIN_TRAIN, folds: int = FOLDS, ratios: Sequence[float] = RATIOS, n_alphas: int = ALPHAS) -> DataFrame:
    """A fit per refit. What goes there are the moments at the edges of its folds: running sums, a few numbers each, whatever the history's length."""
    k = len(features)
    before = Window.partitionBy("index_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    # Centred on the series' first row, so that sums keep their digits.
    first = Window.partitionBy("index_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    z = known.select("index_id", "_at", F.col("_y"), *[F.first(c).over(first).alias(f"_f{i}") for i, c in enumerate(features)], *[(F.col(c) - F.first(c).over(first)).alias(f"_z{i}") for i, c in enumerate(features)])
    zs = [F.col(f"_z{i}") for i in range(k)]
    terms = [*zs, *[zs[i] * zs[j] for i in range(k) for j in range(i, k)], *[x * F.col("_y") for x in zs], F.col("_y"), F.col("_y") * F.col("_y")]
    sums = z.select("index_id", "_at", F.array(*[F.col(f"_f{i}") for i in range(k)]).alias("_first"), F.array(*[F.coalesce(F.sum(t).over(before), F.lit(0.0)) for t in terms]).alias("_sums"))
    # The edges of contiguous folds: the first n % folds have one row more.
    edge = lambda f: f * F.floor(F.col("trained") / folds) + F.least(F.lit(f), F.col("trained") % folds)
    edges = schedule(known, steps, refit, least).select("*", F.explode(F.array(*[edge(f).cast("long") for f in range(folds + 1)])).alias("_at"))
    # Fits are dealt over all cores, however little data they are.
    jobs = edges.join(sums, ["index_id", "_at"]).repartition(known.sparkSession.sparkContext.defaultParallelism, "index_id", "refit")

    def unpacked(n: int, v: np.ndarray) -> Moments:
        xx, upper = np.zeros((k, k)), np.triu_indices(k)
        xx[upper] = v[k : k + len(upper[0])]
        xx = xx + xx.T - np.diag(np.diag(xx))
        return Moments(n, v[:k], xx, v[-k - 2 : -2], v[-2], v[-1])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_at").drop_duplicates("_at")
        coef, level, alpha, ratio = fit([unpacked(n, np.asarray(v)) for n, v in zip(g["_at"], g["_sums"])], ratios, n_alphas)
        one = g.iloc[0]
        level -= float(coef @ np.asarray(one["_first"]))
        return pd.DataFrame([(one["index_id"], one["refit"], one["at"], one["trained"], coef.tolist(), level, alpha, ratio)], columns=[c.split()[0] for c in FIT.split(", ")])

    return jobs.groupBy("index_id", "refit").applyInPandas(run, FIT)


def walk_forward(rows: DataFrame, features: Sequence[str], target: str, steps: int, refit: int = REFIT, least: int = MIN_TRAIN, fits: DataFrame | None = None, **more) -> DataFrame:
    """rows (index_id, pos, target, features) -> index_id, pos, fc and the fit it comes from. Rows with a missing value are dropped and numbered anew."""
    known = numbered(rows, features, target)
    fits = refits(known, features, steps, refit, least, **more) if fits is None else fits
    ready = known.where(F.col("_at") - steps + 1 >= least).withColumn("refit", F.floor(F.col("_at") / refit).cast("long"))
    fc = F.col("level")
    for i, name in enumerate(features):
        fc = fc + F.get("coef", F.lit(i)) * F.col(name)
    return ready.join(fits, ["index_id", "refit"]).select("index_id", "pos", "refit", fc.alias("fc"), "at", "trained", "coef", "alpha", "ratio")


def coefficient_summary(fits: DataFrame, features: Sequence[str]) -> DataFrame:
    """fits, a row per refit. Per series and feature: mean absolute coefficient, and the share of refits that keep it."""
    one = fits.select("index_id", "refit", "coef")
    names = F.array(*[F.lit(n) for n in features])
    x = one.select("index_id", F.explode(F.arrays_zip(names.alias("feature"), F.col("coef").alias("c"))).alias("x"))
    return x.groupBy("index_id", F.col("x.feature").alias("feature")).agg(F.avg(F.abs("x.c")).alias("mean_abs"), F.avg((F.col("x.c") != 0).cast("double")).alias("kept"))
