"""The data source of many files: a partition a file, pruning by date, failures of all files, sheets with junk above, clamped chunks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import month_of_float, number
from tidemark.operators import series
from tidemark.sources import chunked, tables

D = dt.date


def landed(tmp_path):
    files = []
    for name, clamp in (("a", False), ("b", True)):
        for year in (2000, 2001, 2002):
            days = [D(year, m, 1) for m in range(1, 13)] if not clamp else [D(2002, 11, 1), D(2002, 12, 1)]
            path = tmp_path / f"{name}-{year}.csv"
            path.write_text("any,header\n" + "".join(f"{d},{'.' if d.month == 5 else d.year + d.month / 100}\n" for d in days))
            files.append((name, f"{year}-01-01", f"{year}-12-31", str(path)))
    return files


def test_chunks_are_partitions_and_dates_choose_them(spark, tmp_path):
    files = landed(tmp_path)
    rows = chunked.read_chunks(spark, files)
    assert rows.rdd.getNumPartitions() == 6 and rows.count() == 42
    for f in files[:2]:  # outside the dates asked for: never opened
        open(f[3], "w").write("broken\n\x00")
    some = rows.where(F.col("date") >= F.lit("2002-03-01").cast("date")).where("series_id = 'a'")
    assert some.count() == 10 and some.agg(F.count(number(F.col("raw_value")))).first()[0] == 9


def test_a_clamped_series_stands_alone(spark, tmp_path):
    rows = chunked.read_chunks(spark, landed(tmp_path)).withColumn("value", number(F.col("raw_value")))
    assert chunked.failures(rows) == {}
    got = series.from_chunks(rows.select("series_id", "since", "until", "date", "value")).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("v"), F.min("date").alias("first")).collect()
    assert {(r.series_id, r.n, r.v, r.first) for r in got} == {("a", 36, 33, D(2000, 1, 1)), ("b", 2, 2, D(2002, 11, 1))}


def test_all_files_are_tried(spark, tmp_path):
    (tmp_path / "good.csv").write_text("d,v\n2000-01-01,1\nnot a date,2\n")
    (tmp_path / "none.csv").write_text("d,v\n2000-01-01,.\n")
    (tmp_path / "bytes.csv").write_bytes(b"d,v\n\xff\xfe\xff,1\n")
    (tmp_path / "empty.csv").write_text("")
    at = lambda n: str(tmp_path / f"{n}.csv")
    with pytest.raises(ValueError) as e:
        tables.read_all_series(spark, {n: at(n) for n in ("good", "none", "bytes", "gone")})
    assert all(f"{n}:" in str(e.value) for n in ("none", "bytes", "gone")) and "good:" not in str(e.value)
    with pytest.raises(ValueError, match="empty: no values"):
        tables.read_all_series(spark, {"good": at("good"), "empty": at("empty")})
    got = tables.read_all_series(spark, {"good": at("good")}).collect()
    assert {(r.series_id, r.date, r.value) for r in got} == {("good", D(2000, 1, 1), 1.0), ("good", None, 2.0)}


def test_a_landed_sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("Some title,,\njunk,1,2\n Date ,P,D\n1871.01,4.44,0.26\n1871.1,4.5,x\nfooter,,\n")
    rows = chunked.read_chunks(spark, [("s", None, None, str(path))], header="Date", column=2)
    got = rows.select(month_of_float(number(F.col("raw_date"))).alias("month"), number(F.col("raw_value")).alias("d")).where("month IS NOT NULL").collect()
    assert {(r.month, r.d) for r in got} == {(D(1871, 1, 31), 0.26), (D(1871, 10, 31), None)}
