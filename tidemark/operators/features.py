"""Point-in-time features: valuation anchors, transforms with publication lags, indicators, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import growth
from .blocks import haloed, own
from .order import BLOCK, slid
from .series import positioned
from .windows import SERIES, ordered, trailing, whole

EARNINGS_WINDOW, MEDIAN_WINDOW, GROWTH_WINDOW = 120, 360, 240
BANDS = (0.05, 0.25, 0.75, 0.95)


def with_valuation(prices: DataFrame) -> DataFrame:
    """prices (index_id, date, p, e, ...) with e10, the mean of the rows before, and cape; rows without either go."""
    w = ordered("date").rowsBetween(-EARNINGS_WINDOW, -1)
    v = prices.withColumn("e10", F.when(F.count("e").over(w) == EARNINGS_WINDOW, F.avg("e").over(w)))
    return positioned(v.where("e10 > 0 AND p > 0").withColumn("cape", F.col("p") / F.col("e10")))


def valuation_features(valuation: DataFrame, blocks: int = BLOCK) -> DataFrame:
    """log_p, log_cape, e10n, g (20-year growth), cape_star, bands q05..q95, pctile, gap. All look back over a bounded number of rows, so a series is dealt in blocks of positions."""
    names = ["cape_star", *[f"q{round(b * 100):02d}" for b in BANDS]]
    f = valuation.select("*", F.ln("p").alias("log_p"), F.ln("cape").alias("log_cape"), F.try_divide("p", "cape").alias("e10n"))
    f = haloed(f, blocks, before=max(GROWTH_WINDOW, MEDIAN_WINDOW - 1))
    before = F.lag(F.ln("e10n"), GROWTH_WINDOW).over(ordered(keys=(*SERIES, "_block")))
    f = slid(f.withColumn("g", (F.ln("e10n") - before) / 20), "cape", MEDIAN_WINDOW, (0.5, *BANDS))
    f = f.select(*[c for c in f.columns if c not in ("_q", "_below")], *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)], F.col("_below").alias("pctile"))
    return f.withColumn("gap", F.ln("cape_star") - F.col("log_cape"))


def transformed(df: DataFrame, spec: Sequence[tuple[str, str, int]]) -> DataFrame:
    """index_id, date, pos and per (column, kind, lag) a column `column_kind`: transformed, then held back by its publication lag."""
    o = ordered()
    lag = lambda x, k: F.lag(x, k).over(o)
    out = df.select("index_id", "date", "pos", *[growth(F.col(c), kind, lag).alias(f"{c}_{kind}") for c, kind, _ in spec])
    return out.select("index_id", "date", "pos", *[F.lag(f"{c}_{kind}", k).over(o).alias(f"{c}_{kind}") for c, kind, k in spec])


def rolling_trend(df: DataFrame, n: int = 240, blocks: int = BLOCK) -> DataFrame:
    """Log-linear trend of the last n rows: its level at the row, its slope a year, and the gap from it."""
    t = trailing(n, keys=(*SERIES, "_block"))
    ok = F.count("log_p").over(t) == n
    level = F.regr_intercept("log_p", "pos").over(t) + F.regr_slope("log_p", "pos").over(t) * F.col("pos")
    f = own(haloed(df, blocks, before=n - 1).withColumns({"trend": F.when(ok, level), "trend_growth": F.when(ok, 12 * F.regr_slope("log_p", "pos").over(t))}))
    return f.withColumn("trend_gap", F.col("trend") - F.col("log_p"))


def long(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("index_id", "date")) -> DataFrame:
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in columns]))
    return df.select(*keys, x.alias("_x")).select(*keys, "_x.*")


def indicator_panel(df: DataFrame, indicators: Sequence[tuple[str, str]], yoy: Sequence[str] = (), tail: int = 120, least: int = 24) -> DataFrame:
    """Per (column, direction): last value, z against the last `tail` values (all, if fewer than `least`), share of values below it, date.

    Columns in yoy are shown as changes of logs over 12 values that aren't null, times 100.
    """
    v = long(df, [c for c, _ in indicators]).where("value IS NOT NULL")
    o = ordered("date", ("index_id", "key"))
    if yoy:
        change = 100 * (F.ln("value") - F.lag(F.ln("value"), 12).over(o))
        v = v.withColumn("value", F.when(F.col("key").isin(list(yoy)), change).otherwise(F.col("value"))).where("value IS NOT NULL")
    every = whole(("index_id", "key"))
    back = F.row_number().over(every.orderBy(F.desc("date")))
    v = v.withColumns({"back": back, "n": F.count("value").over(every), "last": F.max_by("value", "date").over(every)})
    recent = F.when((F.col("n") < least) | (F.col("back") <= tail), F.col("value"))
    a = v.groupBy("index_id", "key").agg(F.max("last").alias("value"), F.avg(recent).alias("m"), F.stddev_samp(recent).alias("s"), F.avg((F.col("value") < F.col("last")).cast("int")).alias("pctile"), F.max("date").alias("asof"))
    z = F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0)
    names = F.create_map(*[F.lit(x) for pair in indicators for x in pair])
    return a.select("index_id", "key", "value", z.alias("z"), "pctile", names[F.col("key")].alias("direction"), "asof")


def stance(z: Column, direction: Column) -> Column:
    """z seen from a buyer: bearish indicators count against, neutral ones not at all."""
    return F.when(direction == "bearish", -z).when(direction == "bullish", z).otherwise(0.0)
