"""Series that lie in many small files - chunks of time, or sheets - read side by side: a Python data source with a partition per file."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "series_id string, since date, until date, date date, raw_date string, raw_value string, error string"


@dataclass
class Chunk(InputPartition):
    series_id: str
    since: dt.date | None
    until: dt.date | None
    path: str


def _day(text: str | None) -> dt.date | None:
    try:
        return dt.date.fromisoformat((text or "").strip())
    except ValueError:
        return None


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.chunks = [Chunk(s, _day(a), _day(b), p) for s, a, b, p in json.loads(options["files"])]
        self.header, self.column = options.get("header"), int(options.get("column", "1"))
        self.low, self.high = dt.date.min, dt.date.max

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on the date choose the chunks that are opened; Spark still applies all filters to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("date",) and isinstance(getattr(f, "value", None), dt.date):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, f.value)
            yield f

    def partitions(self) -> list[Chunk]:
        return [c for c in self.chunks if (c.until is None or c.until >= self.low) and (c.since is None or c.since <= self.high)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        """The file's rows below its header; one row with the reason where the file can't be read."""
        p = partition
        try:
            for cells in self._cells(p.path):
                first, value = cells[0] if cells else None, cells[self.column] if len(cells) > self.column else None
                yield (p.series_id, p.since, p.until, _day(first), first, value, None)
        except Exception as e:  # whatever a file fails of; the other files are read all the same
            yield (p.series_id, p.since, p.until, None, None, None, f"{type(e).__name__}: {e}".splitlines()[0])

    def _cells(self, path: str) -> Iterator[list[str]]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with system.open_input_stream(at) as f:
            rows = csv.reader(io.TextIOWrapper(f, encoding="utf-8"))
            for cells in rows:
                if self.header is None or (cells and cells[0].strip() == self.header):
                    break
            yield from rows


class ChunkedSeries(DataSource):
    """Options: files (a JSON list of [series_id, since, until, path]; no bounds: null), column (the value's place), header (what the first cell of the row
    above the body reads; unset: the first row)."""

    @classmethod
    def name(cls) -> str:
        return "chunked_series"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_chunks(spark: SparkSession, files: list[tuple[str, str | None, str | None, str]], header: str | None = None, column: int = 1) -> DataFrame:
    """SCHEMA: the rows of all files, a task for each file. From now on the session hands filters to Python data sources, which choosing files needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkedSeries)
    r = spark.read.format("chunked_series").option("files", json.dumps(files)).option("column", str(column))
    return (r.option("header", header) if header else r).load()


def failures(rows: DataFrame, value: str = "value") -> dict[str, str]:
    """Series that couldn't be read, or that have no value, and why: one job over all files, a row for each that failed."""
    a = rows.groupBy("series_id").agg(F.max("error").alias("error"), F.count(value).alias("n")).where("error IS NOT NULL OR n = 0")
    return {r.series_id: r.error or "no values" for r in a.orderBy("series_id").collect()}
