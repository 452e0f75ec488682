"""Queries that land what they derive from the tables in the shared folder and read it back through the sources; and series too short to score."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scores
from ..sources.tables import DAILY, read_all_series, read_daily_csv, shared_dir, table, with_fallback, without_nan
from .registry import query
from .shown import shown


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kept/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_type AS series_id, ts::DATE AS date, CASE WHEN day(ts::DATE) % 7 <> 0 THEN round(sum(value), 6) END AS value FROM events GROUP BY 1, 2")
def a07_coerced_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series landed as one CSV each, with a dot where a value is missing, and read side by side; all of them must have a value."""
    day = F.to_date("ts")
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), day.alias("observation_date")).agg(F.round(F.sum("value"), 6).alias("v"))
    at = _folder(spark, "series")
    text = F.when(F.dayofmonth("observation_date") % 7 == 0, ".").otherwise(F.col("v").cast("string"))
    d.select("series_id", "observation_date", text.alias("value")).repartition("series_id").write.partitionBy("series_id").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(at)
    files = {re.search("series_id=([^/]+)/", f).group(1): f for f in spark.read.text(at).inputFiles()}
    return read_all_series(spark, files).select("series_id", "date", "value")


_BARS = """SELECT o_orderpriority AS series_id, o_orderdate::DATE AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2"""


@query(f"""WITH b AS ({_BARS}), a AS (SELECT * FROM b WHERE series_id <> '5-LOW' AND volume > 1), c AS (SELECT * FROM b WHERE series_id NOT IN (SELECT series_id FROM a))
    SELECT *, 'primary' AS source FROM a UNION ALL SELECT *, 'second' FROM c""")
def a09_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by priority: what the first source gives, and whole series from the second where the first has none. Rows without a close don't count."""
    x = F.col("o_totalprice")
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(
        F.min_by(x, "o_orderkey").alias("open"), F.max(x).alias("high"), F.min(x).alias("low"), F.max_by(x, "o_orderkey").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )
    first, second = _folder(spark, "bars"), _folder(spark, "bars")
    landed = lambda d, to: d.repartition("series_id").write.partitionBy("series_id").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(to)
    landed(b.withColumn("close", F.when((F.col("series_id") != "5-LOW") & (F.col("volume") > 1), F.col("close"))), first)
    landed(b, second)
    one, other = (read_daily_csv(spark, at, 1995) for at in (first, second))
    return with_fallback(one, other, ["series_id"]).select("series_id", *DAILY.names, "source")


@query("""WITH p AS (SELECT o_custkey, o_totalprice AS p, o_orderkey, lag(o_totalprice) OVER w AS fc, avg(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bench FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    a AS (SELECT c_custkey::BIGINT AS k, count(p)::BIGINT AS n, count(fc)::BIGINT AS scored, 1 - sum((p - fc) * (p - fc)) / nullif(sum(CASE WHEN fc IS NOT NULL THEN (p - bench) * (p - bench) END), 0) AS r2,
        CASE WHEN stddev_samp(p) > 0 THEN (arg_max(p, o_orderkey) - avg(p)) / stddev_samp(p) END AS z FROM customer LEFT JOIN p ON o_custkey = c_custkey GROUP BY 1)
    SELECT k, n, scored, round(CASE WHEN scored >= 3 THEN r2 END, 6) AS r2, round(z, 6) AS z, CASE WHEN n = 0 THEN 'empty' WHEN scored < 3 THEN 'short' WHEN r2 IS NULL THEN 'flat' ELSE 'scored' END AS state FROM a""")
def b16_short_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as a series, most of them short and some empty: what can be scored is, and why the rest is not."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("p"), F.lag("o_totalprice").over(w).alias("fc"), F.avg("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("bench"))
    p, fc = F.col("p"), F.col("fc")
    sd = F.stddev_samp(p)
    own = o.groupBy("o_custkey").agg(
        F.count(p).alias("n"), F.count(fc).alias("scored"), scores.r2(p, fc, F.col("bench"), fc.isNotNull()).alias("r2"), F.when(sd > 0, (F.max_by(p, "o_orderkey") - F.avg(p)) / sd).alias("z")
    )
    a = without_nan(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(own, F.col("k") == F.col("o_custkey"), "left").fillna(0, ["n", "scored"]))
    short = F.col("scored") < 3
    state = F.when(F.col("n") == 0, "empty").when(short, "short").when(F.col("r2").isNull(), "flat").otherwise("scored")
    return shown(a.withColumns({"state": state, "r2": F.when(~short, F.col("r2"))}), "k n scored r2 z state")
