"""Series: resampling, spines, joins of tables, coverage profiles and annual pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept


def last_valid(df: DataFrame, period: Column, keys: Sequence[str], at: str, tie: str, value: str) -> DataFrame:
    """keys, period, value: the last value of each period that isn't null. One shuffle, combined before it."""
    picked = F.max_by(F.col(value), F.struct(at, tie)).alias(value)
    return df.where(F.col(value).isNotNull()).groupBy(*keys, period.alias("period")).agg(picked)


def month_spine(df: DataFrame, date: str = "date") -> DataFrame:
    """Every month's last day between the first and the last date, a row each."""
    ends = df.agg(F.min(F.last_day(date)).alias("a"), F.max(F.last_day(date)).alias("b"))
    months = F.expr("sequence(trunc(a, 'MM'), trunc(b, 'MM'), interval 1 month)")
    return ends.where("a IS NOT NULL").select(F.explode(months).alias("m")).select(F.last_day("m").alias("date"))


def on_spine(spine: DataFrame, *tables: DataFrame, by: str = "date") -> DataFrame:
    """The spine's rows with the tables' columns, null where a table has none."""
    for t in tables:
        spine = spine.join(t, by, "left")
    return spine


def merged(*tables: DataFrame, by: str = "date") -> DataFrame:
    """Full outer join of all tables by one key."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, by, "full_outer")
    return out


def coverage(df: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """Per column: first and last date with a value, number of values, rows in that span, and the share missing in it. df is computed once."""
    df = kept(df.select(date, *columns))
    long = df.select(date, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(date, "x.*")
    found = F.when(F.col("value").isNotNull(), F.col(date))
    ends = long.groupBy("column").agg(F.min(found).alias("first"), F.max(found).alias("last"), F.count("value").alias("valid"))
    span = long.join(F.broadcast(ends.select("column", "first", "last")), "column").where(F.col(date).between(F.col("first"), F.col("last")))
    span = span.groupBy("column").agg(F.count(F.lit(1)).alias("span"))
    return ends.join(span, "column", "left").select("column", "first", "last", "valid", F.coalesce("span", F.lit(0)).alias("span"), (1 - F.try_divide("valid", "span")).alias("missing_rate"))


def coverage_lines(profile: DataFrame) -> DataFrame:
    """The profile as lines of a table in Markdown."""
    return profile.select("column", F.format_string("| %s | %s | %s | %d | %d |", "column", F.col("first").cast("string"), F.col("last").cast("string"), "valid", "span").alias("line"))


def annual_pivots(daily: DataFrame, keys: Sequence[str] = ("index_id",)) -> DataFrame:
    """The next year's pivot levels from a year's high, low and last close; provisional while the year ends before December 28."""
    y = daily.groupBy(*keys, F.year("date").alias("y")).agg(F.max("high").alias("prev_high"), F.min("low").alias("prev_low"), F.max_by("close", "date").alias("prev_close"), F.max("date").alias("last"))
    p = (F.col("prev_high") + F.col("prev_low") + F.col("prev_close")) / 3
    y = y.withColumn("mid", p)
    return y.select(
        *keys, (F.col("y") + 1).alias("year"), "prev_high", "prev_low", "prev_close", "mid",
        (2 * F.col("mid") - F.col("prev_low")).alias("r1"), (2 * F.col("mid") - F.col("prev_high")).alias("s1"),
        (F.col("mid") + F.col("prev_high") - F.col("prev_low")).alias("r2"), (F.col("mid") - F.col("prev_high") + F.col("prev_low")).alias("s2"),
        (F.col("last") < F.make_date(F.col("y"), F.lit(12), F.lit(28))).alias("provisional"),
    )


def sheet_body(cells: DataFrame, row: str = "row", first: str = "c0", header: str = "Date") -> DataFrame:
    """The rows below the first one whose first cell reads `header`."""
    at = cells.where(F.trim(first) == header).agg(F.min(row).alias("_at"))
    return cells.join(F.broadcast(at), F.col(row) > F.col("_at")).drop("_at")  # one row


def nearest(df: DataFrame, targets: Sequence[tuple[str, str]], date: str = "date") -> DataFrame:
    """For each (date, label) of a short list a row: target, label and the row whose date is nearest, the earlier on a tie.

    One scan with partial aggregation; nothing is joined.
    """
    row, found = F.struct(*df.columns), []
    for day, label in targets:
        at = F.lit(day).cast("date")
        order = F.struct(F.abs(F.datediff(date, at)), F.col(date))
        found.append(F.struct(at.alias("target"), F.lit(label).alias("label"), F.min_by(row, order).alias("r")))
    picked = df.agg(F.array(*found).alias("found")).select(F.explode("found").alias("x")).where("x.r IS NOT NULL")
    return picked.select("x.target", "x.label", "x.r.*")


def from_chunks(rows: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """rows (keys, since, until, date, ...) read in chunks since..until of a series: their union, a date once.

    A source that ignores the bounds gives rows after a chunk's end; then the first such chunk is all there is, and stands alone.
    """
    chunk = Window.partitionBy(*keys, "since")
    r = rows.withColumn("_clamped", F.min("date").over(chunk) > F.col("until"))
    whole = Window.partitionBy(*keys)
    r = r.withColumn("_only", F.min(F.when(F.col("_clamped"), F.col("since"))).over(whole))
    r = r.where(F.col("_only").isNull() | (F.col("since") == F.col("_only")))
    first = F.row_number().over(Window.partitionBy(*keys, "date").orderBy("since"))
    return r.withColumn("_first", first).where("_first = 1").drop("_first", "_clamped", "_only", "since", "until")


def latest_valid(df: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """Per column its last value that isn't null, and that value's date."""
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(date, x.alias("x")).select(date, "x.*").where("value IS NOT NULL")
    return long.groupBy("column").agg(F.max_by("value", date).alias("value"), F.max(date).alias("asof"))


def positioned(df: DataFrame, order: str = "date", keys: Sequence[str] = ("index_id",), name: str = "pos") -> DataFrame:
    """A place from 0 in each series; the sort is by series, not over the whole table."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
