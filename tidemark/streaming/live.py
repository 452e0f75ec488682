"""Streaming forms: hourly windows with a watermark, a stateful exponentially weighted variance, live re-anchoring."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.distribution import re_anchored
from ..operators.volatility import DECAY
from ..sources.tables import shared_dir


def stream_of(spark: SparkSession, folder: str, like: DataFrame, files: str = "*", files_per_batch: int = 1) -> DataFrame:
    """The folder's files of that name as a stream, with the columns of `like`; times get the session's zone, as watermarks need."""
    s = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", files).parquet(folder)
    return s.withColumns({c: F.col(c).cast("timestamp") for c, t in s.dtypes if t == "timestamp_ntz"})


def hourly(events: DataFrame, late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Count, sum and last value by series and hour; an hour is final when the watermark has passed it."""
    w = events.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), F.col("event_type").alias("series_id"))
    a = w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))
    return a.select("series_id", F.col("w.start").alias("hour"), "n", "total", "last")


def published(events: DataFrame, lag_hours: dict[str, int]) -> DataFrame:
    """events with `available`, the time from which each is known: its own plus its series' publication lag.

    Windows and watermarks of what was known when go by this column.
    """
    lag = F.lit(0)
    for series, hours in lag_hours.items():
        lag = F.when(F.col("event_type") == series, hours).otherwise(lag)
    return events.withColumn("available", F.col("ts") + F.make_dt_interval(hours=lag))


def folded_ewma(v: float, n: int, r: np.ndarray, decay: float = DECAY) -> tuple[float, int]:
    """The variance v after n returns, and n, once r has come; the first return of all starts it."""
    if len(r) and n == 0:
        v, n, r = float(r[0] ** 2), 1, r[1:]
    for at in range(0, len(r), 500):
        some = r[at : at + 500]
        v = float(decay ** len(some) * v + (1 - decay) * (decay ** np.arange(len(some) - 1, -1, -1) @ some**2))
    return v, n + len(r)


def ewma_stream(ticks: DataFrame, decay: float = DECAY) -> DataFrame:
    """ticks (series_id, ts, event_id, r) -> series_id, ts, v after each batch: one running variance per series is all the state.

    The ticks of a batch are taken in the order of time and id; a batch is as large as its trigger lets it be.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        v, n = folded_ewma(*(state.get if state.exists else (0.0, 0)), got["r"].dropna().to_numpy(), decay)
        state.update((v, n))
        yield pd.DataFrame({"series_id": [key[0]], "ts": [got["ts"].max()], "v": [v], "n": [n]})

    return ticks.groupBy("series_id").applyInPandasWithState(step, "series_id string, ts timestamp, v double, n long", "v double, n long", "update", GroupStateTimeout.NoTimeout)


def live_quotes(quotes: DataFrame, leaves: DataFrame) -> DataFrame:
    """quotes (index_id, ts, spot) joined with the stored leaves, a row per series, and re-anchored."""
    return re_anchored(quotes.join(F.broadcast(leaves), "index_id"), F.coalesce("spot", "p0"))  # a leaf per series


def finished(stream: DataFrame, mode: str = "append", every: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote, kept in the shared folder; in update mode with its `batch`.

    every: a processing-time trigger, ended when all input is through; otherwise all input is taken at once in batches.
    A batch that is tried again replaces what it wrote.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{at}/state").outputMode(mode)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{at}/out").start()
    else:
        q = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{at}/out/batch={i}")).start()
    if every:
        q.processAllAvailable()
        q.stop()
    q.awaitTermination()
    schema = stream.schema if mode == "append" else StructType([*stream.schema, StructField("batch", IntegerType())])
    return spark.read.schema(schema).parquet(f"{at}/out")
