"""Reading and writing tables: Parquet between stages, coerced CSV at the edge, JSON documents and Markdown at the end."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import number, present
from .chunked import failures, read_chunks

#: Explicit schemas of the monthly tables; nothing is inferred.
VALUATION = T.StructType([T.StructField("date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in "P D E CPI GS10 real_P real_D real_E E10 CAPE".split()]])
DAILY = T.StructType([T.StructField("date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in "open high low close volume".split()]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a new one (tests)."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_to = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to


def _kept_at(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/kept/{spark.sparkContext.applicationId}"


def kept(df: DataFrame, parts: int | None = None) -> DataFrame:
    """df computed once: a table in the shared folder, which survives lost executors, until forget()."""
    spark, at = df.sparkSession, f"{_kept_at(df.sparkSession)}/{uuid.uuid4().hex}"
    (df if parts is None else df.coalesce(parts)).write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def forget(spark: SparkSession) -> None:
    """Removes what this application has kept, once the results that read it are stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_kept_at(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null once, at the scan; the engine knows only null."""
    return df.select(*[present(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def read_series_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """series_id (the file's name), date, value of two-column files by position, with a header of any wording; `.` and junk are null."""
    raw = spark.read.schema("_d string, _v string").option("header", True).option("enforceSchema", True).csv(paths)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return raw.select(name.alias("series_id"), F.col("_d").try_cast("date").alias("date"), number(F.col("_v")).alias("value"))


def read_all_series(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """series_id, date, value of every file by name, read side by side. All are tried before it fails, with the names of those that can't be read or have no value."""
    rows = read_chunks(spark, [(name, None, None, path) for name, path in paths.items()]).withColumn("value", number(F.col("raw_value")))
    failed = failures(rows) if paths else {"none": "no files"}
    missing = set(paths) - {r.series_id for r in rows.select("series_id").distinct().collect()} if paths and not failed else set()
    failed |= {name: "no values" for name in sorted(missing)}
    if failed:
        raise ValueError("series failed: " + "; ".join(f"{k}: {v}" for k, v in failed.items()))
    return rows.where("error IS NULL").select("series_id", "date", "value")


def isolated(primary: DataFrame, others: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """primary with the rows of the others, and why those that failed are missing; a failure there never breaks the primary.

    Each of the others is computed and kept here, so that it fails here.
    """
    failed = {}
    for name, made in others.items():
        try:
            primary = primary.unionByName(kept(made()))
        except Exception as e:  # whatever a secondary table fails of
            failed[name] = str(e).splitlines()[0]
    return primary, failed


def read_daily_csv(spark: SparkSession, path: str, min_year: int | None = None) -> DataFrame:
    """Open, high, low, close and volume by day; fails if the history starts after min_year."""
    df = without_nan(spark.read.schema(DAILY).option("header", True).csv(path)).where("date IS NOT NULL AND close IS NOT NULL")
    if min_year is not None:
        require(df, F.min(F.year("date")) <= min_year, f"history must start by {min_year}")
    return df


def with_fallback(primary: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """primary, and of second the series (`keys`) of which primary has no row; `source` says which. Columns are primary's.

    Sources aren't mixed inside a series, as their levels may differ. The keys that primary has are the smaller side of an anti-join.
    """
    rest = second.join(primary.select(*keys).distinct(), keys, "left_anti").select(*primary.columns)
    return primary.withColumn("source", F.lit("primary")).unionByName(rest.withColumn("source", F.lit("second")))


def require(df: DataFrame, condition: Column, message: str) -> None:
    """Fails unless an aggregate condition over df holds."""
    if not df.agg(condition.alias("ok")).first().ok:
        raise ValueError(message)


def checked(df: DataFrame, checks: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """A row per check (and key): whether its aggregate condition over df holds; unknown is no. All checks are one pass."""
    a = df.groupBy(*keys).agg(*[F.coalesce(c, F.lit(False)).alias(f"_c{i}") for i, c in enumerate(checks.values())])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_c{i}").alias("ok")) for i, n in enumerate(checks)]))
    return a.select(*keys, each.alias("_x")).select(*keys, "_x.*")


def history_checks(date: str, value: str, first: str, at: dict[str, tuple[float, float]], by_year: int) -> dict[str, Column]:
    """The checks of a monthly history: no month without a row, the first day, values of given months within bounds, and a start early enough.

    The months of one history are counted by differences alone, so nothing is joined.
    """
    day = lambda text: F.lit(text).cast("date")
    month = F.year(date) * 12 + F.month(date)
    value_of = lambda text: F.avg(F.when(F.last_day(date) == F.last_day(day(text)), F.col(value)))
    return {
        "no month missing": F.count_distinct(month) == F.max(month) - F.min(month) + 1, "first day": F.min(date) == day(first),
        **{f"value of {text[:7]}": value_of(text).between(low, high) for text, (low, high) in at.items()}, f"starts by {by_year}": F.min(F.year(date)) <= by_year,
    }


def require_all(found: DataFrame) -> DataFrame:
    """checked()'s rows; fails with the names of all checks that don't hold."""
    failed = [" ".join(str(v) for v in r[:-1]) for r in found.where("NOT ok").collect()]
    if failed:
        raise ValueError("checks failed: " + "; ".join(sorted(failed)))
    return found


def read_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A nested JSON document as one row."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A nested JSON document as one row; no row where there is no file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return read_document(spark, path, schema) if there else spark.createDataFrame([], schema)


def write_document(df: DataFrame, path: str) -> None:
    """Each row as one JSON document, a line each."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Parquet in folders by the given columns, replaced as a whole."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_days(df: DataFrame, path: str, day: str = "ingest_date") -> None:
    """Parquet in a folder per day; days that df has are replaced as a whole, all others stay, so a run of one day may be repeated."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def read_days(spark: SparkSession, path: str, upto: str | None = None, only: str | None = None, day: str = "ingest_date") -> DataFrame:
    """What was written by write_days: all days, those up to a day, or one; others' folders aren't read."""
    df = spark.read.parquet(path)
    if only is not None:
        return df.where(F.col(day) == F.lit(only).cast("date"))
    return df if upto is None else df.where(F.col(day) <= F.lit(upto).cast("date"))


def as_ingested(days: DataFrame, keys: list[str], day: str = "ingest_date") -> DataFrame:
    """Of rows that came again on a later day, the last ones."""
    rest = [c for c in days.columns if c not in (*keys, day)]
    return days.groupBy(*keys).agg(F.max(day).alias(day), F.max_by(F.struct(*rest), day).alias("_r")).select(*keys, day, "_r.*")


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV with a header, dates as ISO; null is empty."""
    df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def leaves_of(documents: DataFrame, column: str = "document", index: str = "main", horizon: str = "12mo") -> DataFrame:
    """documents (JSON of either schema) as a row per index and horizon: index_id, horizon, spot, p0, mu, sigma beside the document's other columns.

    A document is parsed once, as a variant; its schema_version says where its leaves are: in indices and horizons, or, in the older schema, at the top, as
    the leaf of `index` and `horizon`. What isn't JSON has no leaf.
    """
    d = documents.withColumn("_d", F.try_parse_json(column)).where("_d IS NOT NULL")
    newer = F.coalesce(F.try_variant_get("_d", "$.schema_version", "int"), F.lit(1)) >= 2
    named = lambda v, path: F.try_variant_get(v, path, "map<string,variant>")
    keep = [c for c in documents.columns if c != column]
    d = d.select(*keep, newer.alias("_newer"), F.explode(F.when(newer, named("_d", "$.indices")).otherwise(F.create_map(F.lit(index), F.col("_d")))).alias("index_id", "_x"))
    d = d.withColumn("spot", F.try_variant_get("_x", "$.spot", "double"))
    d = d.select(*keep, "index_id", "spot", F.explode(F.when(F.col("_newer"), named("_x", "$.horizons")).otherwise(F.create_map(F.lit(horizon), F.col("_x")))).alias("horizon", "_l"))
    return d.select(*keep, "index_id", "horizon", "spot", *[F.try_variant_get("_l", f"$.{c}", "double").alias(c) for c in ("p0", "mu", "sigma")])


def latest_version(candidates: DataFrame, fallback: str, asof: Column, days: int = 120) -> DataFrame:
    """candidates (path, source, last) -> the path to take: the newest of the first source if it's fresh, else of the fallback."""
    fresh = F.max(F.when((F.col("source") != fallback) & (F.datediff(asof, "last") <= days), F.struct("last", "path")))
    other = F.max(F.when(F.col("source") == fallback, F.struct("last", "path")))
    return candidates.agg(F.coalesce(fresh["path"], other["path"]).alias("path"))
