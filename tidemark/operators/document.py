"""The forecast document of schema 2: indices, their horizons, and for each a leaf with all that a reader draws from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_even
from .distribution import FAN

SCHEMA = 2
#: How far growth and valuation may be from the forecast that they add up to.
PARTS = 1e-9


def checked(mu: Column, growth: Column, valuation: Column) -> Column:
    """mu; fails where its parts don't add up to it."""
    off = F.abs(growth + valuation - mu) > PARTS
    return F.when(off | off.isNull(), F.raise_error(F.lit("the parts of a forecast don't add up to it")).cast("double")).otherwise(mu)


def decomposed(leaves: DataFrame) -> DataFrame:
    """leaves (mu, growth, valuation, years) with what each part and the whole give a year, in per cent; fails where parts don't add up."""
    mu = checked(F.col("mu"), F.col("growth"), F.col("valuation"))
    a_year = lambda x: 100 * (F.exp(x / F.col("years")) - 1)
    out = leaves.withColumns({"growth_pct": a_year(F.col("growth")), "total_pct": a_year(mu)})
    return out.withColumn("valuation_pct", F.col("total_pct") - F.col("growth_pct"))


def fan_path(steps: Column) -> Column:
    """Months from 0 and prices at five levels."""
    month = F.sequence(F.lit(0), steps)
    at = lambda m, i: F.col("p0") * F.exp(F.col("mu") * m / steps + F.col("sigma") * F.get("z", F.lit(i)) * F.sqrt(m / steps))
    path = lambda i: F.transform(month, lambda m: half_even(at(m, i), 2))
    return F.struct(month.alias("months"), *[path(i).alias(n) for n, i in FAN.items()])


def leaf(calibration: Column | None = None) -> Column:
    """A leaf of schema 2 from the columns of a live forecast: p0, mu, sigma, z, z01, z025, lam_used, growth, valuation, horizon_months, tier, model."""
    price = lambda i: F.col("p0") * F.exp(F.col("mu") + F.col("sigma") * F.get("z", F.lit(i)))
    pairs = lambda of: F.map_from_entries(F.array(*[F.struct(F.lit(n), of(i)) for n, i in FAN.items()]))
    more = [calibration.alias("calibration")] if calibration is not None else []
    return F.struct(
        "horizon_months", "tier", "p0", checked(F.col("mu"), F.col("growth"), F.col("valuation")).alias("mu"), "sigma",
        F.struct(F.lit("level0").alias("drift"), F.col("model").alias("vol"), F.lit("fhs").alias("shape"), F.col("lam_used").alias("lambda_used")).alias("model"),
        pairs(lambda i: half_even(100 * (price(i) / F.col("p0") - 1), 2)).alias("return_quantiles_pct"), pairs(lambda i: half_even(price(i), 2)).alias("price_quantiles"),
        F.col("z").alias("z_grid"), F.struct(F.col("z01").alias("p01"), F.col("z025").alias("p025")).alias("z_tail"), fan_path(F.col("horizon_months")).alias("fan_path"),
        F.struct("growth", "valuation").alias("return_decomp"), *more,
    )


def _by_name(order: Column, name: Column, value: Column) -> Column:
    """An aggregate: a map from name to value, in order."""
    found = F.collect_list(F.struct(order.alias("o"), name.alias("k"), value.alias("v")))
    sign = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    return F.map_from_entries(F.transform(F.array_sort(found, sign), lambda x: F.struct(x["k"], x["v"])))


def forecast_document(leaves: DataFrame, indicators: DataFrame | None = None, calibration: list[str] | None = None, default: tuple[str, str] = ("main", "12mo")) -> DataFrame:
    """document: one row, the document as JSON. leaves: a row per index_id and horizon; indicators: rows by index_id.

    A document has as many leaves as there are indices times horizons, so gathering them is what it asks for.
    """
    cal = F.struct(*calibration) if calibration else None
    keep = _by_name(F.col("horizon_months"), F.col("horizon"), leaf(cal))
    valuation = F.struct(*[F.max_by(c, "horizon_months").alias(c) for c in ("cape", "cape_star")])
    one = leaves.groupBy("index_id").agg(F.max("p0").alias("spot"), F.max("asof").alias("asof"), keep.alias("horizons"), valuation.alias("valuation"))
    kinds = F.struct("key", "value", "z", "pctile", "direction", F.col("asof").cast("string").alias("asof"))
    if indicators is not None:
        shown = indicators.groupBy("index_id").agg(F.array_sort(F.collect_list(kinds)).alias("indicators"))
        one = one.join(shown, "index_id", "left")
    parts = ["spot", *(["indicators"] if indicators is not None else []), "horizons", "valuation"]
    indices = _by_name(F.col("index_id"), F.col("index_id"), F.struct(F.col("index_id").alias("label"), *parts))
    doc = one.agg(F.max("asof").cast("string").alias("asof"), indices.alias("indices"))
    head = [F.lit(SCHEMA).alias("schema_version"), "asof", F.struct(F.lit(default[0]).alias("index"), F.lit(default[1]).alias("horizon")).alias("default")]
    return doc.where("asof IS NOT NULL").select(F.to_json(F.struct(*head, "indices")).alias("document"))


def older_document(leaves: DataFrame, horizon: str = "12mo") -> DataFrame:
    """index_id, document: the older schema, one leaf at the top, a document for each index."""
    return leaves.where(F.col("horizon") == horizon).select("index_id", F.to_json(F.struct(F.col("asof").cast("string").alias("asof"), F.col("p0").alias("spot"), "p0", "mu", "sigma")).alias("document"))



def common_horizon(leaves: DataFrame, asked: DataFrame, default: str = "12mo") -> DataFrame:
    """asked (asked: a horizon, a row each) with `horizon`: the asked one where every index of leaves has it, else the default."""
    of = leaves.agg(F.count_distinct("index_id").alias("_all"))  # one row
    have = leaves.groupBy("horizon").agg(F.count_distinct("index_id").alias("_n"))  # a row per horizon
    every = have.join(F.broadcast(of)).where(F.col("_n") == F.col("_all")).select(F.col("horizon").alias("asked"), F.lit(True).alias("_ok"))
    return asked.join(F.broadcast(every), "asked", "left").select("asked", F.when(F.col("_ok"), F.col("asked")).otherwise(default).alias("horizon"))


def variant(neutral: Column, tier: Column) -> Column:
    """What a headline says: neutral for an index without an anchor, long-run for far horizons, else plain."""
    return F.when(neutral, "neutral").when(tier == "long-run", "long-run").otherwise("plain")


def headline(leaves: DataFrame, neutral: Column) -> DataFrame:
    """index_id, horizon, variant and line: prices and returns of the median and both ranges; for far horizons the return a year and how many windows there were."""
    price = lambda n: F.col("p0") * F.exp(F.col("mu") + F.col("sigma") * F.get("z", F.lit(FAN[n])))
    pct = lambda n: 100 * (price(n) / F.col("p0") - 1)
    windows = F.greatest(F.lit(1).cast("long"), F.floor(F.col("pool") / F.col("horizon_months")).cast("long"))
    which = variant(neutral, F.col("tier"))
    ranges = [price("q05"), price("q95"), price("q25"), price("q75")]
    plain = F.format_string("%s %s: %.0f to %.0f (%+.1f%%), 90%% %.0f to %.0f, 50%% %.0f to %.0f", "index_id", "horizon", "p0", price("q50"), pct("q50"), *ranges)
    far = F.format_string("%s %s: %+.1f%% a year, %+.1f%% in all, from %d windows", "index_id", "horizon", 100 * (F.exp(F.col("mu") / F.col("years")) - 1), pct("q50"), windows)
    without = F.format_string("%s %s, no anchor: %+.1f%% (%+.1f%% to %+.1f%%)", "index_id", "horizon", pct("q50"), pct("q05"), pct("q95"))
    return leaves.select("index_id", "horizon", which.alias("variant"), F.when(which == "neutral", without).when(which == "long-run", far).otherwise(plain).alias("line"))
