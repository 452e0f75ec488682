"""Queries of the ingest layer: scans, coercion, resampling, spines, joins, profiles, pivots."""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import available, half_even, month_of_float, named, number
from ..operators import series
from ..sources.chunked import read_chunks
from ..sources.tables import as_ingested, checked, history_checks, kept, latest_version, read_days, shared_dir, table, write_days
from .panel import BASE, day_prices, prices, shipments, sql
from .registry import query
from .shown import picked, shown

TARGETS = (("1996-03-10", "first"), ("1998-07-01", "middle"), ("2000-02-29", "leap"), ("2030-01-01", "after"))
ASOF = ("2001-09-30", "2002-09-30")
_CHUNK_DAYS, _TRAILING = 8, 5


@query("""WITH c AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey < 3 THEN 'junk' WHEN n_nationkey = 3 THEN ' Date ' ELSE (1990 + n_nationkey)::VARCHAR || '.' || lpad((n_nationkey % 14)::VARCHAR, 2, '0') END AS c0,
    CASE WHEN n_nationkey % 5 = 0 THEN '.' ELSE (n_nationkey * 2)::VARCHAR || '.5' END AS c1 FROM nation),
    d AS (SELECT k, try_cast(c0 AS DOUBLE) AS x, try_cast(c1 AS DOUBLE) AS value FROM c WHERE k > (SELECT min(k) FROM c WHERE trim(c0) = 'Date'))
    SELECT k::BIGINT AS k, CASE WHEN round((x - floor(x)) * 100) BETWEEN 1 AND 12 THEN last_day(make_date(floor(x)::INT, round((x - floor(x)) * 100)::INT, 1)) END AS month, value FROM d""")
def a02_sheet_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    c0 = F.when(k < 3, "junk").when(k == 3, " Date ").otherwise(F.concat((k + 1990).cast("string"), F.lit("."), F.lpad((k % 14).cast("string"), 2, "0")))
    c1 = F.when(k % 5 == 0, ".").otherwise(F.concat((k * 2).cast("string"), F.lit(".5")))
    body = series.sheet_body(table(spark, sf_dir, "nation").select(k.alias("k"), c0.alias("c0"), c1.alias("c1")), "k")
    return body.select(F.col("k").cast("long").alias("k"), month_of_float(number(F.col("c0"))).alias("month"), number(F.col("c1")).alias("value"))


@query(f"""WITH c AS (SELECT o_orderpriority || '/' || o_orderstatus || '/' || year(o_orderdate) AS path, CASE WHEN o_orderpriority = '5-LOW' THEN 'mirror' ELSE 'primary' END AS source, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1, 2)
    SELECT d AS asof, coalesce((SELECT arg_max(path, (last, path)) FROM c WHERE source <> 'mirror' AND d - last <= 120), (SELECT arg_max(path, (last, path)) FROM c WHERE source = 'mirror')) AS path FROM (VALUES {', '.join(f"(DATE '{d}')" for d in ASOF)}) v(d)""")
def a04_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the years' files of every kind of order the newest, seen from a day while they are fresh and from one when only the mirror is left."""
    day = F.to_date("o_orderdate")
    path = F.concat_ws("/", "o_orderpriority", "o_orderstatus", F.year(day).cast("string"))
    c = table(spark, sf_dir, "orders").groupBy(path.alias("path"), F.when(F.col("o_orderpriority") == "5-LOW", "mirror").otherwise("primary").alias("source")).agg(F.max(day).alias("last"))
    each = [latest_version(c, "mirror", F.lit(d).cast("date")).select(F.lit(d).cast("date").alias("asof"), "path") for d in ASOF]
    return each[0].unionByName(each[1])


@query("""SELECT event_type, count(*)::BIGINT AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(CASE WHEN (props->>'$.k')::BIGINT % 7 <> 0 THEN 1 END)::BIGINT AS valid FROM events GROUP BY 1""")
def a11_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    text = F.when(k % 7 == 0, ".").otherwise(k.cast("string"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.count(number(text)).alias("valid"))


_HOURLY = """h AS (SELECT event_type, date_trunc('hour', ts) AS hour, arg_max(value, (ts, event_id)) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""


@query(f"""WITH {_HOURLY} SELECT hour, {', '.join(f"max(CASE WHEN event_type = '{e}' THEN value END) AS {e}" for e in ("click", "error", "purchase", "signup", "view"))} FROM h GROUP BY 1""")
def a08_pivoted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = series.last_valid(table(spark, sf_dir, "events"), F.date_trunc("hour", "ts"), ["event_type"], "ts", "event_id", "value")
    return h.groupBy(F.col("period").alias("hour")).pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.first("value"))


@query(sql(BASE, """m AS (SELECT last_day(date) AS date, arg_max(close, date) AS close FROM px WHERE index_id = 'main' AND close > 100000 GROUP BY 1),
    s AS (SELECT unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS x FROM px)""") + " SELECT last_day(x)::DATE AS date, m.close FROM s LEFT JOIN m ON m.date = last_day(x)")
def d03_month_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = kept(day_prices(spark, sf_dir).select("date", "close"))
    m = series.last_valid(p.withColumn("close", F.when(F.col("close") > 100000, F.col("close"))), F.last_day("date"), [], "date", "date", "close")
    return series.on_spine(series.month_spine(p), m.withColumnRenamed("period", "date"))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per day with main's prices, shipments and the side's price: orders and lineitem are scanned once each."""
    return series.merged(day_prices(spark, sf_dir), shipments(spark, sf_dir))


_MASTER = "ms AS (SELECT date, a.p, high, low, close, e, d, rate, spread, level, b.p AS p_side FROM (SELECT * FROM px WHERE index_id = 'main') a FULL JOIN sh USING (date) FULL JOIN (SELECT date, p FROM px WHERE index_id = 'side') b USING (date))"


@query(sql(BASE, _MASTER) + " SELECT " + picked("date", "p high low close ln_e ln_d rate spread level p_side") + " FROM (SELECT *, ln(e) AS ln_e, ln(d) AS ln_d FROM ms)")
def c01_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = master(spark, sf_dir).withColumns({"ln_e": F.ln("e"), "ln_d": F.ln("d")})
    return shown(m, "date p high low close ln_e ln_d rate spread level p_side")


_COVERAGE = """lo AS (SELECT date, 'p' AS "column", p AS value FROM ms UNION ALL SELECT date, 'e', e FROM ms UNION ALL SELECT date, 'p_side', p_side FROM ms),
    en AS (SELECT "column", min(CASE WHEN value IS NOT NULL THEN date END) AS first, max(CASE WHEN value IS NOT NULL THEN date END) AS last, count(value) AS valid FROM lo GROUP BY 1),
    cv AS (SELECT "column", any_value(first) AS first, any_value(last) AS last, any_value(valid) AS valid, count(*) AS span FROM lo JOIN en USING ("column") WHERE date BETWEEN first AND last GROUP BY 1)"""


@query(sql(BASE, _MASTER, _COVERAGE) + """ SELECT "column", first, last, valid::BIGINT AS valid, span::BIGINT AS span, round(1 - valid / span::DOUBLE, 6) AS missing_rate FROM cv""")
def d01_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(series.coverage(master(spark, sf_dir), ["p", "e", "p_side"]), "column first last valid span missing_rate")


@query(sql(BASE, _MASTER, _COVERAGE) + """ SELECT "column", '| ' || "column" || ' | ' || first::VARCHAR || ' | ' || last::VARCHAR || ' | ' || valid || ' | ' || span || ' |' AS line FROM cv""")
def a15_coverage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.coverage_lines(series.coverage(master(spark, sf_dir), ["p", "e", "p_side"]))


@query(sql(BASE, """y AS (SELECT index_id, year(date) AS y, max(high) AS prev_high, min(low) AS prev_low, arg_max(close, date) AS prev_close, max(date) AS last FROM px GROUP BY 1, 2),
    z AS (SELECT *, (prev_high + prev_low + prev_close) / 3 AS mid FROM y)""") + """ SELECT index_id, (y + 1)::BIGINT AS year, prev_high, prev_low, prev_close, round(mid, 6) AS mid, round(2 * mid - prev_low, 6) AS r1, round(2 * mid - prev_high, 6) AS s1,
    round(mid + (prev_high - prev_low), 6) AS r2, round(mid - (prev_high - prev_low), 6) AS s2, last < make_date(y::INT, 12, 28) AS provisional FROM z""")
def d02_annual_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(series.annual_pivots(prices(spark, sf_dir)), "index_id year prev_high prev_low prev_close mid r1 s1 r2 s2 provisional")


@query(sql(BASE, "t(target, label) AS (VALUES " + ", ".join(f"(DATE '{d}', '{n}')" for d, n in TARGETS) + ")") + " SELECT target, label, arg_min(date, (abs(date - target), date)) AS date, round(arg_min(p, (abs(date - target), date)), 6) AS p FROM t CROSS JOIN (SELECT date, p FROM px WHERE index_id = 'main') GROUP BY 1, 2")
def c08_nearest_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(series.nearest(prices(spark, sf_dir).where("index_id = 'main'").select("date", "p"), TARGETS), "target label date p")


@query(sql(BASE, _MASTER, """lv AS (UNPIVOT (SELECT date, p, e, p_side FROM ms) ON p, e, p_side INTO NAME "column" VALUE value)""") + """ SELECT "column", round(arg_max(value, date), 6) AS value, max(date) AS asof FROM lv GROUP BY 1""")
def c09_latest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(series.latest_valid(master(spark, sf_dir), ["p", "e", "p_side"]), "column value asof")


@query(sql(BASE) + """ SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT date FROM px UNION SELECT date FROM sh) UNION ALL SELECT 'all', count(*) FROM (SELECT date FROM px UNION ALL SELECT date FROM sh)
    UNION ALL SELECT 'both', count(*) FROM (SELECT date FROM px INTERSECT SELECT date FROM sh) UNION ALL SELECT 'only', count(*) FROM (SELECT date FROM px EXCEPT SELECT date FROM sh)""")
def g01_date_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables' days meet once; every set is a count over that."""
    a = prices(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("a"))
    b = shipments(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("b"))
    count = lambda x: F.count(F.when(x, 1))
    ours, theirs = F.col("a").isNotNull(), F.col("b").isNotNull()
    sets = {"union": F.count(F.lit(1)), "all": F.sum(F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))), "both": count(ours & theirs), "only": count(ours & ~theirs)}
    one = series.merged(a, b).agg(*[x.alias(n) for n, x in sets.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("op"), F.col(n).cast("long").alias("n")) for n in sets])).alias("x")).select("x.*")


@query(sql(BASE) + """ SELECT index_id, count(*)::BIGINT AS n, count(CASE WHEN year(date) >= 1998 THEN 1 END)::BIGINT AS since_1998, count(CASE WHEN date > m - INTERVAL 24 MONTH THEN 1 END)::BIGINT AS last_two_years,
    min(date) AS first, round(avg(greatest(100000.0, least(200000.0, p))), 6) AS held, bool_and(p > 0) AS positive FROM px JOIN (SELECT index_id, max(date) AS m FROM px GROUP BY 1) USING (index_id) GROUP BY 1""")
def b13_eras_and_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from ..functions.columns import clip

    p = prices(spark, sf_dir).withColumn("m", F.max("date").over(Window.partitionBy("index_id")))
    count = lambda x: F.count(F.when(x, 1))
    return p.groupBy("index_id").agg(
        F.count(F.lit(1)).alias("n"), count(F.year("date") >= 1998).alias("since_1998"), count(F.col("date") > F.add_months("m", -24)).alias("last_two_years"),
        F.min("date").alias("first"), F.round(F.avg(clip(F.col("p"), 100000, 200000)), 6).alias("held"), F.bool_and(F.col("p") > 0).alias("positive"),
    )


_BOUNDS = {"1995-01-31": (140_000.0, 160_000.0), "2000-01-31": (150_000.0, 150_100.0)}
_VALUE_SQL = "avg(CASE WHEN last_day(date) = DATE '{0}' THEN p END) BETWEEN {1!r} AND {2!r}"


@query(sql(BASE, f"""ck AS (SELECT index_id, count(DISTINCT year(date) * 12 + month(date)) = max(year(date) * 12 + month(date)) - min(year(date) * 12 + month(date)) + 1 AS a, min(date) = DATE '1995-01-01' AS b,
    {', '.join(f'{_VALUE_SQL.format(d, lo, hi)} AS v{i}' for i, (d, (lo, hi)) in enumerate(_BOUNDS.items()))}, min(year(date)) <= 1995 AS e FROM px GROUP BY 1)""")
    + " UNION ALL ".join(f" SELECT index_id, '{n}' AS name, coalesce({c}, false) AS ok FROM ck" for n, c in (("no month missing", "a"), ("first day", "b"), *((f"value of {d[:7]}", f"v{i}") for i, d in enumerate(_BOUNDS)), ("starts by 1995", "e"))))
def b07_history_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five checks of a landed history, for each index."""
    return checked(prices(spark, sf_dir), history_checks("date", "p", "1995-01-01", _BOUNDS, 1995), ("index_id",))


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'bullish' WHEN 'error' THEN 'bearish' ELSE 'neutral: ' || event_type END AS direction, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def b15_named_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return e.select("event_type", named(F.col("event_type"), {"click": "bullish", "error": "bearish"}, F.concat(F.lit("neutral: "), F.col("event_type"))).alias("direction"), "mean")


@query(f"""WITH d AS (SELECT event_type AS series_id, ts::DATE AS date, round(sum(value), 6) AS value FROM events GROUP BY 1, 2), b AS (SELECT min(date) AS lo FROM d)
    SELECT series_id, date, value FROM d CROSS JOIN b WHERE date >= lo + 10""")
def a01_landed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series landed as a file per series and eight days, read back side by side from the tenth day on; files before that aren't opened."""
    e = table(spark, sf_dir, "events")
    lo = e.agg(F.to_date(F.min("ts")).alias("d")).first().d
    day = F.to_date("ts")
    chunk = F.date_add(F.lit(lo), (F.floor(F.datediff(day, F.lit(lo)) / _CHUNK_DAYS) * _CHUNK_DAYS).cast("int"))
    d = e.groupBy(F.col("event_type").alias("series_id"), day.alias("date")).agg(F.round(F.sum("value"), 6).alias("value"), F.first(chunk).alias("since"))
    at = f"{shared_dir(spark)}/kept/{spark.sparkContext.applicationId}/chunks-{uuid.uuid4().hex}"
    d.repartition("series_id", "since").write.partitionBy("series_id", "since").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(at)
    landed = [(*re.search("series_id=([^/]+)/since=([^/]+)/", f).groups(), f) for f in spark.read.text(at).inputFiles()]
    files = [(s, since, str(dt.date.fromisoformat(since) + dt.timedelta(_CHUNK_DAYS - 1)), f) for s, since, f in landed]
    rows = read_chunks(spark, files).where(F.col("date") >= F.lit(lo + dt.timedelta(10)))
    return series.from_chunks(rows.select("series_id", "since", "until", "date", number(F.col("raw_value")).alias("value"))).select("series_id", "date", "value")


_LATE = "1998-06-30"


@query(f"""WITH d AS (SELECT o_orderkey AS key, last_day(o_orderdate)::DATE AS day, o_totalprice AS price FROM orders), c AS (SELECT * FROM d WHERE key % 7 <> 0 OR day <> (SELECT max(day) FROM d WHERE day <= DATE '{_LATE}')
        UNION ALL SELECT key, DATE '{_LATE}' + 1, price + 1 FROM d WHERE key % 11 = 0 AND day <= DATE '{_LATE}')
    SELECT day AS ingest_date, count(*)::BIGINT AS n, round(sum(price), 2) AS total FROM (SELECT key, max(day) AS day, arg_max(price, day) AS price FROM c WHERE day <= DATE '{_LATE}' + 1 GROUP BY 1) GROUP BY 1""")
def a05_ingest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of orders landed as ingest days; one day is run again without some rows, a late day brings corrections; what counts is each key's last day up to then."""
    day = F.last_day("o_orderdate")
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), day.alias("ingest_date"))
    at = f"{shared_dir(spark)}/kept/{spark.sparkContext.applicationId}/days-{uuid.uuid4().hex}"
    late = F.date_add(F.lit(_LATE).cast("date"), 1)
    again = d.where(F.col("ingest_date") <= F.lit(_LATE).cast("date")).agg(F.max("ingest_date").alias("ingest_date"))  # one row
    write_days(d, at)
    write_days(d.join(F.broadcast(again), "ingest_date", "left_semi").where("key % 7 <> 0"), at)
    write_days(d.where((F.col("key") % 11 == 0) & (F.col("ingest_date") < late)).select("key", (F.col("price") + 1).alias("price"), late.alias("ingest_date")), at)
    seen = as_ingested(read_days(spark, at, upto="1998-07-01"), ["key"])
    return seen.groupBy("ingest_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query(f"""WITH d AS (SELECT event_type AS series_id, ts::DATE AS date, round(sum(value), 6) AS value FROM events GROUP BY 1, 2), b AS (SELECT min(date) AS lo, max(date) AS hi FROM d)
    SELECT series_id, date, value FROM d CROSS JOIN b WHERE series_id <> 'error' OR date > hi - {_TRAILING}""")
def a06_chunked_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series read in chunks of eight days; the source of one ignores bounds and gives its last days every time."""
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("date")).agg(F.round(F.sum("value"), 6).alias("value"))
    d = kept(d)
    b = d.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))  # one row
    starts = F.explode(F.expr(f"sequence(lo, hi, interval {_CHUNK_DAYS} days)")).alias("since")
    chunks = b.select("hi", starts).withColumn("until", F.date_add("since", _CHUNK_DAYS - 1))
    inside = F.when(F.col("series_id") == "error", F.col("date") > F.date_sub("hi", _TRAILING)).otherwise(F.col("date").between(F.col("since"), F.col("until")))
    return series.from_chunks(d.join(F.broadcast(chunks), inside).drop("hi")).select("series_id", "date", "value")  # a few chunks


@query("SELECT n_nationkey::BIGINT AS k, round_even((n_nationkey - 12) / 4.0::DOUBLE, 0) AS whole, round_even((n_nationkey - 12) / 8.0::DOUBLE, 2) AS cents FROM nation")
def h02_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("k"), half_even((k - 12) / 4, 0).alias("whole"), half_even((k - 12) / 8, 2).alias("cents"))


_HAVE = {"main": ["3mo", "12mo", "36mo"], "side": ["24mo", "60mo"]}
_ASKED = ("3mo", "12mo", "24mo", "240mo")


@query(f"""WITH a AS (SELECT n_nationkey::BIGINT AS k, CASE n_nationkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'side' ELSE 'other' END AS asked_index, [{', '.join(map(repr, _ASKED))}][n_nationkey % {len(_ASKED)} + 1] AS asked FROM nation),
    b AS (SELECT *, CASE WHEN asked_index = 'side' THEN 'side' ELSE 'main' END AS index_id FROM a), c AS (SELECT *, CASE index_id WHEN 'main' THEN {_HAVE['main']} ELSE {_HAVE['side']} END AS have FROM b)
    SELECT k, asked_index, asked, index_id, CASE WHEN list_contains(have, asked) THEN asked WHEN list_contains(have, '12mo') THEN '12mo' ELSE have[1] END AS horizon, NOT list_contains(have, asked) AS fell_back FROM c""")
def k33_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index and horizon that a request gets: as asked where there is one, else the default, else the first."""
    k = F.col("n_nationkey")
    asked = table(spark, sf_dir, "nation").select(k.cast("long").alias("k"), F.get(F.array(*map(F.lit, ("main", "side", "other"))), (k % 3).cast("int")).alias("asked_index"), F.get(F.array(*map(F.lit, _ASKED)), (k % len(_ASKED)).cast("int")).alias("asked"))
    have = F.create_map(*[x for name, keys in _HAVE.items() for x in (F.lit(name), F.array(*map(F.lit, keys)))])
    a = asked.withColumn("index_id", available(F.col("asked_index"), F.map_keys(have), "main"))
    keys = F.try_element_at(have, F.col("index_id"))
    return a.withColumns({"horizon": available(F.col("asked"), keys, "12mo"), "fell_back": ~F.array_contains(keys, F.col("asked"))})
