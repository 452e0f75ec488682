"""Queries that join by time: as-of joins of two large tables, and values as they were known at a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import as_of, known_at, latest_known
from ..sources.tables import table
from .registry import query
from .shown import shown

#: Moments at which the two-time join asks what was known.
SEEN = ("1996-01-15", "1998-01-15", "2001-12-31")


def _as_of_sql(pick: str) -> str:
    return f"""WITH o AS (SELECT o_orderkey AS key, o_orderstatus AS kind, o_orderdate AS t FROM orders),
    l AS (SELECT CASE l_returnflag WHEN 'N' THEN 'O' WHEN 'R' THEN 'F' ELSE 'P' END AS kind, l_shipdate AS t, min(l_orderkey * 10 + l_linenumber) AS line FROM lineitem GROUP BY 1, 2),
    b AS (SELECT o.*, l.t AS before_t, l.line AS before_line FROM o ASOF LEFT JOIN l ON o.kind = l.kind AND o.t >= l.t),
    a AS (SELECT b.*, l.t AS after_t, l.line AS after_line FROM b ASOF LEFT JOIN l ON b.kind = l.kind AND b.t <= l.t)
    SELECT key::BIGINT AS key, {pick} FROM a"""


_NEAR = "after_t IS NULL OR (before_t IS NOT NULL AND t - before_t <= after_t - t)"


def _joined(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    """Every order with a shipment of its kind: the last before it, the first after it, or the nearest."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").alias("at"))
    kind = F.when(F.col("l_returnflag") == "N", "O").when(F.col("l_returnflag") == "R", "F").otherwise("P")
    s = table(spark, sf_dir, "lineitem").select(kind.alias("kind"), F.col("l_shipdate").alias("shipped"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    j = as_of(o, s, "at", "shipped", ["kind"], "line", how)
    return j.select(F.col("key").cast("long").alias("key"), F.to_date("_right.shipped").alias("found"), F.col("_right.line").cast("long").alias("line"))


@query(_as_of_sql("before_t::DATE AS found, before_line::BIGINT AS line"))
def c08_as_of_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, "before")


@query(_as_of_sql("after_t::DATE AS found, after_line::BIGINT AS line"))
def c08_as_of_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, "after")


@query(_as_of_sql(f"CASE WHEN {_NEAR} THEN before_t ELSE after_t END::DATE AS found, CASE WHEN {_NEAR} THEN before_line ELSE after_line END::BIGINT AS line"))
def c08_as_of_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, "nearest")


_SEEN_SQL = ", ".join(f"(DATE '{d}')" for d in SEEN)
_VERSIONS = f"""v AS (SELECT l_returnflag AS series, date_trunc('month', o_orderdate)::DATE AS period, l_shipdate::DATE AS published, sum(l_quantity) AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
    m(seen) AS (VALUES {_SEEN_SQL}),
    k AS (SELECT series, period, seen, max(published) AS published, arg_max(value, published) AS value FROM v JOIN m ON published <= seen GROUP BY 1, 2, 3)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month's figure of orders, published anew on every day that something of it was shipped."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period"))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("published"), "l_quantity")
    return x.join(o, "l_orderkey").groupBy("series", "period", "published").agg(F.sum("l_quantity").alias("value"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = spark.range(1).select(F.explode(F.array(*[F.lit(d).cast("date") for d in SEEN])).alias("seen"))
    return known_at(_versions(spark, sf_dir), moments, ["series"], "period", "published", "seen", ["value"])


@query(f"WITH {_VERSIONS} SELECT series, period, seen, published, round(value, 6) AS value FROM k")
def c10_known_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month's figure as it was known at three moments; a version published later changes later moments only."""
    return shown(_known(spark, sf_dir), "series period seen published value")


@query(f"WITH {_VERSIONS} SELECT series, seen, max(period) AS period, round(arg_max(value, period), 6) AS value FROM k WHERE period <= seen GROUP BY 1, 2")
def c10_latest_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(latest_known(_known(spark, sf_dir), ["series"], "period", "seen", "value"), "series seen period value")
