"""A GARCH variance as a stream: each series keeps its last variance and parameters, asks for new ones in time, and takes them when they come."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.volatility import REFIT

TICKS = "index_id string, pos long, r double, omega double, alpha double, beta double, last double"
OUT = "index_id string, pos long, v double, n long, asks boolean"


def folded_garch(h: float, omega: float, alpha: float, beta: float, r: np.ndarray) -> np.ndarray:
    """The variance after each return; missing ones leave it as it is."""
    out = np.empty(len(r))
    for i, x in enumerate(r):
        h = h if np.isnan(x) else omega + alpha * x * x + beta * h
        out[i] = h
    return out


class Garch(StatefulProcessor):
    """State: h, omega, alpha, beta, and n, the rows since the parameters came. A row with parameters replaces all of it, before the return of its own place.

    A series whose parameters have served `refit` rows sets a timer; when it goes off, a row asks for new ones.
    """

    def __init__(self, refit: int = REFIT):
        self.refit = refit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("garch", "h double, omega double, alpha double, beta double, n long, pos long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        first = initialState.iloc[0]
        self.state.update((float(first["last"]), float(first["omega"]), float(first["alpha"]), float(first["beta"]), 0, int(first["at"])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        got["_tick"] = got["omega"].isna()
        got = got.sort_values(["pos", "_tick"], kind="stable").reset_index(drop=True)
        now = tuple(self.state.get()) if self.state.exists() else None
        fits = np.flatnonzero(~got["_tick"].to_numpy())
        out = []
        for a, b in zip(np.concatenate([[0], fits]), np.concatenate([fits, [len(got)]])):
            part = got.iloc[a:b]
            if len(part) and not part["_tick"].iloc[0]:
                now = (*(float(part[c].iloc[0]) for c in ("last", "omega", "alpha", "beta")), 0, int(part["pos"].iloc[0]))
                part = part.iloc[1:]
            if not len(part):
                continue
            if now is None:  # no parameters yet
                out.append(pd.DataFrame({"index_id": key[0], "pos": part["pos"], "v": np.nan, "n": 0, "asks": False}))
                continue
            v = folded_garch(*now[:4], part["r"].to_numpy(dtype=float))
            n = now[4] + np.arange(1, len(part) + 1)
            out.append(pd.DataFrame({"index_id": key[0], "pos": part["pos"], "v": v, "n": n, "asks": False}))
            now = (float(v[-1]), *now[1:4], int(n[-1]), int(part["pos"].iloc[-1]))
        if now is not None:
            self.state.update(now)
            if now[4] >= self.refit and not list(self.handle.listTimers()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1)
        if out:
            yield pd.concat(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        h, _, _, _, n, pos = self.state.get()
        if n >= self.refit:
            yield pd.DataFrame({"index_id": [key[0]], "pos": [pos], "v": [h], "n": [n], "asks": [True]})

    def close(self) -> None:
        pass


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep this kind of state: it needs the store by column, and, as timers could go off at any time, batches only when there are rows.

    A timer then goes off with the next batch. The session's own settings come back afterwards.
    """
    own = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def garch_stream(ticks: DataFrame, fits: DataFrame | None = None, refit: int = REFIT) -> DataFrame:
    """ticks (as of TICKS: returns, and rows with new parameters) -> OUT: the variance of the period after each return, and rows that ask for parameters.

    fits (index_id, at, omega, alpha, beta, last): a row per series that its state starts from, valid for returns from place `at` on. Returns of a series come
    in the order of their places, batch by batch. Start its query inside stateful().
    """
    start = None if fits is None else fits.groupBy("index_id")
    return ticks.groupBy("index_id").transformWithStateInPandas(Garch(refit), OUT, "Update", "ProcessingTime", initialState=start)
