"""Window specifications of point-in-time work. All are partitioned by series, so series run side by side."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec

SERIES = ("index_id",)


def ordered(order: str = "pos", keys=SERIES) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def done(horizon: int, order: str = "pos", keys=SERIES) -> WindowSpec:
    """Rows whose outcome is known: from the first to `horizon` rows before."""
    return ordered(order, keys).rowsBetween(Window.unboundedPreceding, -horizon)


def trailing(n: int, order: str = "pos", keys=SERIES) -> WindowSpec:
    """The last n rows, this one included."""
    return ordered(order, keys).rowsBetween(-(n - 1), 0)


def whole(keys=SERIES) -> WindowSpec:
    return Window.partitionBy(*keys)
