"""One long series in many tasks: blocks of positions, what a block needs of its neighbours, and totals carried from block to block.

A block holds `rows` positions. Windows with a bounded frame run inside a block that also has the rows just before and after it
(haloed). Totals of all rows so far run inside a block too (summed); the last row of a block has the block's total, and a window over those rows gives
what the blocks before add up to (carried). That is a row a block and is broadcast, so the rows themselves are dealt once and no task has more than a block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept
from .windows import SERIES, done


def placed(df: DataFrame, order: Sequence[str] = ("date",), keys: Sequence[str] = SERIES, name: str = "pos") -> DataFrame:
    """As series.positioned: a place from 0 in each series, but a series may lie in several tasks. df is read twice.

    Rows are range-sorted; each range numbers its rows, and a window over the ranges' counts says where its part of a series begins. Of that there is a
    row per range and series in it, which is broadcast: joined by key, the rows would be dealt once more.
    """
    by = [*keys, *order]
    rows = kept(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftrightunsigned("_at", 33))
    parts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_from"))
    return rows.join(F.broadcast(kept(parts)), [*keys, "_part"]).withColumn(name, F.col("_at") + F.col("_from")).select(*df.columns, name)


def haloed(df: DataFrame, rows: int, before: int = 0, after: int = 0, pos: str = "pos") -> DataFrame:
    """df by blocks: _block, and _own, which is false for the `before` rows before and the `after` rows behind a block that it also gets."""
    at = lambda shift: F.floor((F.col(pos) + shift) / rows).cast("long")
    blocks = F.sequence(F.greatest(at(-after), F.lit(0).cast("long")), at(before)) if before or after else F.array(at(0))
    return df.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == at(0))


def own(df: DataFrame) -> DataFrame:
    """A row once again."""
    return df.where("_own").drop("_block", "_own")


def summed(df: DataFrame, terms: Mapping[str, Column], lag: int, rows: int, pos: str = "pos", keys: Sequence[str] = SERIES) -> DataFrame:
    """haloed df (`lag` rows before at least) with, for every term, its sum over what counts in the row's block: a row counts from `lag` rows later on.

    So the last row of a block has the total of the block.
    """
    if lag > rows:
        raise ValueError("a block must be longer than the lag")
    late = F.floor((F.col(pos) + lag) / rows).cast("long")
    inside = done(lag, pos, (*keys, "_block"))
    return df.withColumns({n: F.sum(F.when(late == F.col("_block"), x)).over(inside) for n, x in terms.items()})


def carried(df: DataFrame, names: Sequence[str], rows: int, pos: str = "pos", keys: Sequence[str] = SERIES) -> DataFrame:
    """df, whose own rows have sums of their block (summed), with the sums of all blocks before added; null where all are null. df is read twice."""
    upto = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = df.where(F.col("_own") & (F.col(pos) % rows == rows - 1)).select(*keys, "_block", *names)
    before = kept(last.select(*keys, (F.col("_block") + 1).alias("_block"), *[F.sum(n).over(upto).alias(f"_c_{n}") for n in names]))
    out = df.join(F.broadcast(before), [*keys, "_block"], "left")
    both = lambda n: F.when(F.col(n).isNotNull() | F.col(f"_c_{n}").isNotNull(), F.coalesce(n, F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)))
    return out.select(*[both(c).alias(c) if c in names else c for c in df.columns])


def scanned(df: DataFrame, terms: Mapping[str, Column], lag: int, rows: int | None = None, pos: str = "pos", keys: Sequence[str] = SERIES) -> DataFrame:
    """df with, for every term, its sum over all rows from the series' first to `lag` rows before this one; null where all are null.

    rows: None for a window over the whole series; else df is haloed by blocks of so many rows, with `lag` rows before at least (lag may not be
    above rows), and positions are without gaps; then only a block's own rows come back, still with _block and _own.
    """
    if rows is None:
        return df.withColumns({n: F.sum(x).over(done(lag, pos, keys)) for n, x in terms.items()})
    return carried(kept(summed(df, terms, lag, rows, pos, keys).where("_own")), list(terms), rows, pos, keys)


#: Moments of a line's pairs.
_MOMENTS = ("n", "x", "y", "xx", "xy")


def paired(df: DataFrame, y: Column, predictors: Mapping[str, Column], lag: int, rows: int, pos: str = "pos", keys: Sequence[str] = SERIES) -> DataFrame:
    """haloed df with what fitted() needs: each predictor's value and moments with y, as summed(), around the block's own means, so they keep their digits."""
    df = df.withColumns({"_y": y, **{f"_p_{n}": x for n, x in predictors.items()}})
    block = Window.partitionBy(*keys, "_block")
    mean = lambda c: F.coalesce(F.avg(c).over(block), F.lit(0.0))
    df = df.withColumns({"_my": mean("_y"), **{f"_m_{n}": mean(f"_p_{n}") for n in predictors}})
    terms = {}
    for n in predictors:
        x, v = F.col(f"_p_{n}") - F.col(f"_m_{n}"), F.col("_y") - F.col("_my")
        both = x.isNotNull() & v.isNotNull()
        terms |= {f"_{n}_{k}": F.when(both, t) for k, t in zip(_MOMENTS, (F.lit(1.0), x, v, x * x, x * v))}
    return summed(df, terms, lag, rows, pos, keys).drop("_y")


def fitted(df: DataFrame, predictors: Sequence[str], least: int, rows: int, pos: str = "pos", keys: Sequence[str] = SERIES) -> DataFrame:
    """Own rows of paired(), kept, with for each name the least-squares line over all rows up to the lag before, at the row; null below `least` pairs.

    Moments move from the block's means to the series' mean of those, a row per series that is broadcast, and are carried on.
    """
    columns = [c for c in df.columns if c not in ("_my", *[f"_{k}_{n}" for n in predictors for k in ("p", "m")], *[f"_{n}_{k}" for n in predictors for k in _MOMENTS])]
    centres = df.where(F.col(pos) % rows == 0).groupBy(*keys).agg(F.avg("_my").alias("_sy"), *[F.avg(f"_m_{n}").alias(f"_s_{n}") for n in predictors])
    df = df.join(F.broadcast(kept(centres)), list(keys))
    moved = {}
    for n in predictors:
        m, dx, dy = {k: F.col(f"_{n}_{k}") for k in _MOMENTS}, F.col(f"_m_{n}") - F.col(f"_s_{n}"), F.col("_my") - F.col("_sy")
        moved |= {
            f"_{n}_x": m["x"] + m["n"] * dx, f"_{n}_y": m["y"] + m["n"] * dy,
            f"_{n}_xx": m["xx"] + 2 * dx * m["x"] + m["n"] * dx * dx, f"_{n}_xy": m["xy"] + dx * m["y"] + dy * m["x"] + m["n"] * dx * dy,
        }
    df = carried(df.withColumns(moved), [f"_{n}_{k}" for n in predictors for k in _MOMENTS], rows, pos, keys)

    def line(n: str) -> Column:
        m = {k: F.col(f"_{n}_{k}") for k in _MOMENTS}
        slope = F.try_divide(m["n"] * m["xy"] - m["x"] * m["y"], m["n"] * m["xx"] - m["x"] * m["x"])
        at = F.col(f"_p_{n}") - F.col(f"_s_{n}")
        return F.when(m["n"] >= least, F.col("_sy") + m["y"] / m["n"] + slope * (at - m["x"] / m["n"]))

    return df.select(*columns, *[line(n).alias(n) for n in predictors])
