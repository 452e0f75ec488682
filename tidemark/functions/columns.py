"""Column functions that the operators share: built-in expressions only."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of a predictive distribution.
GRID = [round(0.05 * k, 2) for k in range(1, 20)]
#: Coefficients of a rational approximation of the normal distribution (numerator, denominator; highest power first).
NORMAL_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
NORMAL_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def present(x: Column) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(x), x)


def clip(x: Column, lo: float, hi: float) -> Column:
    """x held within lo and hi; null stays null, unlike with greatest and least alone."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def number(x: Column) -> Column:
    """Text as a double; what isn't a number becomes null."""
    return present(F.trim(x).try_cast("double"))


def month_of_float(x: Column) -> Column:
    """The month's last day of a date written as year.month with two decimals (1871.1 is October)."""
    year = F.floor(x).cast("int")
    month = F.round((x - F.floor(x)) * 100).cast("int")
    return F.when(month.between(1, 12), F.last_day(F.make_date(year, month, F.lit(1))))


def growth(x: Column, kind: str, lag, steps: int = 12) -> Column:
    """as_is, chg12 (difference) or yoy (difference of logs); lag(column, steps) gives the value before."""
    if kind == "as_is":
        return x
    if kind == "chg12":
        return x - lag(x, steps)
    if kind == "yoy":
        return F.ln(x) - lag(F.ln(x), steps)
    raise ValueError(kind)


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, to about 1e-15 where |x| is below 7; beyond, 0 or 1."""
    a = F.abs(x)

    def poly(terms: tuple) -> Column:
        out = F.lit(terms[0])
        for c in terms[1:]:
            out = out * a + F.lit(c)
        return out

    tail = F.when(a > 7, F.lit(0.0)).otherwise(F.exp(-a * a / 2) * poly(NORMAL_TOP) / poly(NORMAL_BOTTOM))
    return F.when(x > 0, 1 - tail).when(x <= 0, tail)


def t5_cdf(x: Column) -> Column:
    """Student's t with 5 degrees of freedom, in closed form."""
    a = F.atan(x / math.sqrt(5))
    return 0.5 + (a + F.sin(a) * F.cos(a) * (1 + F.pow(F.cos(a), F.lit(2.0)) * 2 / 3)) / math.pi


def _t5(x: float) -> float:
    a = math.atan(x / math.sqrt(5))
    return 0.5 + (a + math.sin(a) * math.cos(a) * (1 + 2 * math.cos(a) ** 2 / 3)) / math.pi


def _t5_quantile(q: float) -> float:
    lo, hi = -60.0, 60.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _t5(mid) < q else (lo, mid)
    return (lo + hi) / 2


#: Quantiles of the grid: normal, and t with 5 degrees of freedom scaled to variance 1.
NORMAL_GRID = [NormalDist().inv_cdf(q) for q in GRID]
T5_GRID = [_t5_quantile(q) * math.sqrt(3 / 5) for q in GRID]


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear through the points (xs rising, ys), held at the ends."""
    i = F.size(F.filter(xs, lambda v: v <= x)) - 1
    at = lambda a, k: F.get(a, k)
    slope = F.try_divide(at(ys, i + 1) - at(ys, i), at(xs, i + 1) - at(xs, i))
    last = F.size(xs) - 1
    return F.when(x <= at(xs, F.lit(0)), at(ys, F.lit(0))).when(x >= at(xs, last), at(ys, last)).otherwise(at(ys, i) + (x - at(xs, i)) * slope)


def named(key: Column, names: dict, default: Column) -> Column:
    """names[key], or the default."""
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def r6(x: Column | str, places: int = 6) -> Column:
    """Rounded for comparison across engines."""
    return F.round(F.col(x) if isinstance(x, str) else x, places)


def half_even(x: Column, places: int) -> Column:
    """Rounded as published documents are: halves to the even digit."""
    return F.bround(x, places)


def available(wanted: Column, keys: Column, default: str) -> Column:
    """wanted if keys has it, else the default if keys has that, else the first key."""
    return F.when(F.array_contains(keys, wanted), wanted).when(F.array_contains(keys, F.lit(default)), F.lit(default)).otherwise(F.get(keys, F.lit(0)))
