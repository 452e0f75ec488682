"""Queries that stream, and those that fit: hourly windows, stateful variances, live quotes, elastic net."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import macro, scores, walk
from ..sources.tables import kept, table
from ..operators.volatility import garch_fits
from ..streaming import garch, live
from .panel import BASE, features, panel, sql, walk_sql
from .point import _MACRO, MACRO_SPEC, SINCE
from .registry import query
from .shown import shown
from .spread import LEAF, leaf


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.stream_of(spark, sf_dir, table(spark, sf_dir, "events"), "events.parquet")


@query("""SELECT event_type AS series_id, date_trunc('hour', ts) AS hour, count(*)::BIGINT AS n, round(sum(value), 6) AS total, round(arg_max(value, (ts, event_id)), 6) AS last FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY 1, 2""")
def i01_stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has closed once all files are read."""
    h = live.finished(live.hourly(_events(spark, sf_dir)))
    return shown(h.withColumn("hour", F.col("hour").cast("timestamp_ntz")), "series_id hour n total last")


@query("""WITH e AS (SELECT event_type, list(ln(1 + value) ORDER BY ts, event_id) AS r, max(ts) AS ts FROM events GROUP BY 1)
    SELECT event_type AS series_id, ts, round(list_reduce(list_prepend(r[1] * r[1], r[2:]), lambda v, x: 0.94 * v + 0.06 * x * x), 6) AS v, len(r)::BIGINT AS n FROM e""")
def i02_stream_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _events(spark, sf_dir).select(F.col("event_type").alias("series_id"), "ts", "event_id", F.ln(1 + F.col("value")).alias("r"))
    got = live.finished(live.ewma_stream(ticks), "update")
    last = got.groupBy("series_id").agg(F.max_by(F.struct("ts", "v", "n"), "batch").alias("x"))
    return shown(last.select("series_id", "x.*").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "series_id ts v n")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 2 HOUR AS seen FROM events)
    SELECT event_type AS series_id, date_trunc('hour', ts) AS hour, count(*)::BIGINT AS n, round(sum(value), 6) AS total, round(arg_max(value, (ts, event_id)), 6) AS last, date_trunc('hour', ts) + INTERVAL 1 HOUR > any_value(seen) AS provisional FROM events CROSS JOIN m GROUP BY 1, 2""")
def i04_provisional_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour as soon as it has a row, in update mode under a processing-time trigger; provisional until the watermark has passed it."""
    h = live.finished(live.hourly(_events(spark, sf_dir)), "update", every="1 second")
    newest = h.groupBy("series_id", "hour").agg(F.max_by(F.struct("n", "total", "last"), "batch").alias("x")).select("series_id", "hour", "x.*")
    seen = table(spark, sf_dir, "events").agg((F.max("ts").cast("timestamp") - F.expr("INTERVAL 2 HOURS")).alias("seen"))
    newest = newest.join(F.broadcast(seen)).withColumn("provisional", F.col("hour") + F.expr("INTERVAL 1 HOUR") > F.col("seen"))  # one row
    return shown(newest.withColumn("hour", F.col("hour").cast("timestamp_ntz")), "series_id hour n total last provisional")


@query()
def i06_stream_garch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variance after each return, streamed from stored fits; parameters come along every 120 rows."""
    f = kept(features(spark, sf_dir).select("index_id", F.col("pos").cast("long").alias("pos"), "r"))
    fits = kept(garch_fits(f, refit=120).where("omega IS NOT NULL"))
    null = F.lit(None).cast("double")
    ticks = f.join(fits.groupBy("index_id").agg(F.min("at").alias("_from")), "index_id").where("pos >= _from").select("index_id", "pos", "r", *[null.alias(c) for c in ("omega", "alpha", "beta", "last")])
    ticks = kept(ticks.unionByName(fits.select("index_id", F.col("at").alias("pos"), null.alias("r"), "omega", "alpha", "beta", "last")), parts=1)
    with garch.stateful(spark):
        got = live.finished(garch.garch_stream(spark.readStream.schema(ticks.schema).parquet(ticks.inputFiles()[0].rsplit("/", 1)[0])), "update")
    return shown(got.where("NOT asks"), "index_id pos v n")


PUBLISHED = {"view": 1, "click": 2, "purchase": 3}


@query(f"""WITH e AS (SELECT *, ts + to_hours(CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in PUBLISHED.items())} ELSE 0 END) AS available FROM events)
    SELECT event_type AS series_id, date_trunc('hour', available) AS hour, count(*)::BIGINT AS n, round(sum(value), 6) AS total, round(arg_max(value, (ts, event_id)), 6) AS last FROM e
    WHERE date_trunc('hour', available) + INTERVAL 1 HOUR <= (SELECT max(available) - INTERVAL 2 HOUR FROM e) GROUP BY 1, 2""")
def i05_publication_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What had become known in each hour, given that series are published some hours late."""
    h = live.finished(live.hourly(live.published(_events(spark, sf_dir), PUBLISHED), time="available"))
    return shown(h.withColumn("hour", F.col("hour").cast("timestamp_ntz")), "series_id hour n total last")


_MOVE = "(kk - 50) / 500.0::DOUBLE"


@query(LEAF + f""" SELECT event_id::BIGINT AS event_id, index_id, round(mu - lam_used * CASE WHEN kk = 50 THEN 0 ELSE ln(1 + {_MOVE}) END, 6) AS mu_live, round(mu - lam_used * ln(1 + {_MOVE}) + sigma * z[10] + ln(p0 * (1 + {_MOVE})), 6) AS log_median
    FROM (SELECT event_id, (props->>'$.k')::BIGINT AS kk, CASE WHEN event_id % 2 = 0 THEN 'main' ELSE 'side' END AS index_id FROM events) JOIN lf USING (index_id)""")
def i03_stream_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes around the last prices, streamed against the stored leaves of both indices."""
    stored = kept(leaf(spark, sf_dir).select("index_id", "mu", "sigma", "z", "p0", "lam_used"))
    p0 = stored.select("index_id", F.col("p0").alias("_p"))
    move = 1 + (F.from_json("props", "k long")["k"] - 50) / 500.0
    quotes = _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 2 == 0, "main").otherwise("side").alias("index_id"), move.alias("move"))
    quotes = quotes.join(F.broadcast(p0), "index_id").withColumn("spot", F.col("_p") * F.col("move"))  # a row per series
    got = live.finished(live.live_quotes(quotes, stored).select("event_id", "index_id", "mu_live", F.ln("price_q50").alias("log_median")))
    return shown(got, "event_id index_id mu_live log_median")


#: The macro models: target over the anchor or the outcome itself, and the features.
MODERN_SPEC = [*MACRO_SPEC, ("rate", "as_is", 1)]
ELASTIC = {"core_residual": ("resid", MACRO_SPEC), "core_standalone": ("realized", MACRO_SPEC), "modern_residual": ("resid", MODERN_SPEC)}


def _named(spec: list) -> list[str]:
    return [f"{c}_{k}" for c, k, _ in spec]


def macro_rows(f: DataFrame, spec: list) -> DataFrame:
    """Origins with their lagged features."""
    o = walk.walk(f).select("index_id", "date", F.col("pos").cast("long").alias("pos"), "realized", "fc_level0_est", "fc_drift_only", "fc_rw_drift", (F.col("realized") - F.col("fc_level0_est")).alias("resid"))
    return o.join(feat.transformed(f, spec).withColumn("pos", F.col("pos").cast("long")).drop("date"), ["index_id", "pos"])


def elastic(f: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """The forecasts of one mode beside its benchmarks, and its fits."""
    target, spec = ELASTIC[mode]
    rows = macro_rows(f, spec)
    fits = kept(macro.refits(macro.numbered(rows, _named(spec), target), _named(spec), 12))
    fc = macro.walk_forward(rows, _named(spec), target, 12, fits=fits).select("index_id", "pos", "fc")
    whole = F.col("fc") + F.col("fc_level0_est") if target == "resid" else F.col("fc")
    return kept(rows.join(fc, ["index_id", "pos"]).withColumn("full", whole)), fits


@query()
def k16_elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a macro model beat the anchor: on what the anchor leaves, on the outcome itself, and with one feature more?"""
    f, out = panel(spark, sf_dir), None
    for mode in ELASTIC:
        j, fits = elastic(f, mode)
        r, a, b = F.col("realized"), F.col("full"), F.col("fc_level0_est")
        late = F.year("date") >= SINCE
        m = j.groupBy("index_id").agg(
            F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.sqrt(F.avg((r - a) * (r - a))).alias("rmse"), F.sqrt(F.avg((r - b) * (r - b))).alias("rmse_level0"),
            scores.r2(r, a, b).alias("r2_level0"), scores.r2(r, a, F.col("fc_drift_only")).alias("r2_drift"), scores.r2(r, a, F.col("fc_rw_drift")).alias("r2_mean"),
            F.when(F.count(F.when(late, 1)) > 50, scores.r2(r, a, b, late)).alias("r2_level0_late"), scores.direction_hit(a, r).alias("hit"), scores.direction_hit(b, r).alias("hit_level0"),
        )
        m = m.join(scores.clark_west(j, r, b, a, ["index_id"], "pos").drop("n"), "index_id").join(fits.groupBy("index_id").agg(F.count(F.lit(1)).alias("refits")), "index_id")
        one = shown(m, "index_id n first last rmse rmse_level0 r2_level0 r2_drift r2_mean r2_level0_late hit hit_level0 cw_t cw_p_halved cw_p_onesided refits").withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def d14_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, out = panel(spark, sf_dir), None
    for mode, (target, spec) in ELASTIC.items():
        fits = macro.refits(macro.numbered(macro_rows(f, spec), _named(spec), target), _named(spec), 12)
        one = shown(macro.coefficient_summary(fits, _named(spec)), "index_id feature mean_abs kept").withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


_KNOWN = " AND ".join(f"{n} IS NOT NULL" for n in _named(MACRO_SPEC))


@query(sql(BASE, _MACRO, walk_sql(), f"kn AS (SELECT og.index_id, og.pos, row_number() OVER (PARTITION BY og.index_id ORDER BY og.pos) - 1 AS place FROM og JOIN mx USING (index_id, pos) WHERE {_KNOWN}), rd AS (SELECT *, place // 12 AS refit FROM kn WHERE place - 11 >= 180)")
    + " SELECT index_id, pos::BIGINT AS pos, refit::BIGINT AS refit, (min(place) OVER (PARTITION BY index_id, refit))::BIGINT AS at, (min(place) OVER (PARTITION BY index_id, refit) - 11)::BIGINT AS trained FROM rd")
def e32_refit_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refit that each forecast's coefficients come from, the row it was made at, and how many outcomes it knew."""
    known = macro.numbered(macro_rows(panel(spark, sf_dir), MACRO_SPEC), _named(MACRO_SPEC), "resid")
    ready = known.where("_at - 11 >= 180").select("index_id", "pos", F.floor(F.col("_at") / 12).cast("long").alias("refit"))
    return shown(ready.join(macro.schedule(known, 12), ["index_id", "refit"]), "index_id pos refit at trained")
