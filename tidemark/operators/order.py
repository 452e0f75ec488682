"""Exact order statistics of what a row may know: over all completed rows so far, and over the last n rows.

A wavelet matrix of the values' ranks, in the order of the rows, answers "the k-th smallest of rows a to b" and "how many of rows a to b are
below x" in as many steps as ranks have bits, for all rows of a task at once. So a row's cost doesn't grow with its past, and no row carries it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import GRID
from ..sources.tables import kept
from .blocks import haloed, placed
from .windows import SERIES

#: Rows of a sliding block; rows whose quantiles are looked up at once.
BLOCK, AT_ONCE = 65_536, 8192


class Wavelet:
    """Selection and counting in ranges of a sequence of whole numbers below 2 ** bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            on = (values >> b & 1).astype(bool)
            self.levels.append((b, np.concatenate([[0], np.cumsum(~on)])))
            values = np.concatenate([values[~on], values[on]])

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k-th smallest (from 0) of each range lo..hi (hi excluded), and its place among its equals.

        more: how many further elements are below each value 0..2 ** bits, which every range has besides.
        """
        out = np.zeros(len(k), dtype=np.int64)
        for b, zeros in self.levels:
            a, z = zeros[lo], zeros[hi]
            left = z - a if more is None else z - a + more[out + (1 << b)] - more[out]
            right = k >= left
            k = np.where(right, k - left, k)
            lo, hi = np.where(right, zeros[-1] + lo - a, a), np.where(right, zeros[-1] + hi - z, z)
            out += right.astype(np.int64) << b
        return out, k

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of each range are below the value."""
        out, size = np.zeros(len(value), dtype=np.int64), 1 << len(self.levels)
        every, span = value >= size, hi - lo
        for b, zeros in self.levels:
            a, z = zeros[lo], zeros[hi]
            right = (value >> b & 1).astype(bool)
            out += np.where(right, z - a, 0)
            lo, hi = np.where(right, zeros[-1] + lo - a, a), np.where(right, zeros[-1] + hi - z, z)
        return np.where(every, span, out)


class Sorted:
    """A sequence of numbers, some missing, whose ranges of places can be asked for quantiles and shares."""

    def __init__(self, values: np.ndarray):
        known = ~np.isnan(values)
        self.before = np.concatenate([[0], np.cumsum(known)])
        v = values[known]
        by = np.argsort(v, kind="stable")
        self.values, rank = v[by], np.empty(len(v), dtype=np.int64)
        rank[by] = np.arange(len(v))
        self.wavelet = Wavelet(rank, max(1, len(v).bit_length()))

    def counts(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.before[hi] - self.before[lo]

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, equal: bool) -> np.ndarray:
        """Values below x (equal: or at x) in each range of places."""
        return self.wavelet.below(self.before[lo], self.before[hi], np.searchsorted(self.values, x, "right" if equal else "left"))

    def quantiles(self, lo: np.ndarray, hi: np.ndarray, levels: Sequence[float]) -> np.ndarray:
        """A row per range, linear between neighbours; NaN where a range has no value."""
        lo, hi = self.before[lo], self.before[hi]
        out = np.full((len(lo), len(levels)), np.nan)
        filled = np.flatnonzero(hi > lo)
        for i in range(0, len(filled), AT_ONCE):
            rows = filled[i : i + AT_ONCE]
            k, share = places(hi[rows] - lo[rows], levels)
            twice = np.repeat(rows, k.shape[1])
            found = self.values[self.wavelet.kth(lo[twice], hi[twice], k.ravel())[0]].reshape(k.shape)
            out[rows] = between(found, share)
        return out


def places(n: np.ndarray, levels: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """For n values each, the places that the levels lie between (two a level) and how far."""
    at = (n[:, None] - 1) * np.asarray(levels)
    low, high = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
    return np.stack([low, high], axis=2).reshape(len(n), 2 * len(levels)), at - low


def between(found: np.ndarray, share: np.ndarray) -> np.ndarray:
    low, high = found[:, ::2], found[:, 1::2]
    return low + share * (high - low)


def _by_series(rows: DataFrame, keys: Sequence[str], order: str, run: Callable[[pa.Table], dict[str, pa.Array]], more: str) -> DataFrame:
    """rows with the columns that run gives for each whole series (table sorted by order)."""
    names = rows.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held).combine_chunks()
            made = run(t)
            yield from pa.table([*[t[n] for n in names], *made.values()], names=[*names, *made]).to_batches(max_chunksize=AT_ONCE)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            starts = np.flatnonzero(t["_first"].to_numpy())
            for a, b in zip(starts, [*starts[1:], t.num_rows]):
                if a == starts[0] and a > 0:
                    held.append(t.slice(0, a))
                if held:
                    yield from done()
                held = [t.slice(a, b - a)]
            if not len(starts):
                held.append(t)
        if held:
            yield from done()

    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.withColumn("_first", first).mapInArrow(each, f"{kinds}, {more}")


def _numbers(t: pa.Table, column: str) -> np.ndarray:
    return t[column].cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def _lists(values: np.ndarray) -> pa.Array:
    """Rows as lists; a row of NaN as null."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()), mask=pa.array(np.isnan(values[:, 0])))


def expanding(rows: DataFrame, of: Mapping[str, tuple[str, str]], lag: int, keys: Sequence[str] = SERIES, order: str = "opos", levels: Sequence[float] = tuple(GRID), blocks: int | None = None) -> DataFrame:
    """rows with, for each name: (value, x) in `of`, over the values of all rows from the series' first to `lag` rows before:
    name_q (quantiles at the levels, null without a value), name_below (share of them at or below x) and name_n (their number).

    blocks: None for a series a task; else series of any length, in blocks of so many rows, by positions (order, without gaps from 0).
    """
    more = ", ".join(f"{n}_q array<double>, {n}_below double, {n}_n long" for n in of)
    if blocks is not None:
        for n, (value, x) in of.items():
            rows = _expanding_in_blocks(rows, n, value, x, lag, keys, order, levels, blocks)
        return rows

    def run(t: pa.Table) -> dict[str, pa.Array]:
        out = {}
        hi = np.maximum(np.arange(t.num_rows) - lag + 1, 0)
        lo = np.zeros_like(hi)
        for n, (value, x) in of.items():
            s, at = Sorted(_numbers(t, value)), _numbers(t, x)
            m = s.counts(lo, hi)
            share = s.below(lo, hi, at, equal=True) / np.maximum(m, 1)
            out |= {f"{n}_q": _lists(s.quantiles(lo, hi, levels)), f"{n}_below": pa.array(share, mask=(m == 0) | np.isnan(at)), f"{n}_n": pa.array(m)}
        return out

    return _by_series(rows, keys, order, run, more)


#: What a block asks buckets for, and what they answer. i: a row's value (0, 1, ..), a slice of the bucket (-1), one of its values (-2).
_ASKED = {"_block": pa.int64(), "u": pa.int64(), "i": pa.int64(), "y": pa.float64(), "o": pa.int64(), "k": pa.int64(), "k_end": pa.int64(), "base": pa.int64(), "total": pa.int64()}
_ASKED_KINDS = "_block long, u long, i long, y double, o long, k long, k_end long, base long, total long"


def _asks(keys: Mapping[str, pa.Scalar], **columns: np.ndarray | int) -> pa.Table:
    """Rows of _ASKED under the same keys; columns that aren't given are 0."""
    n = max([0, *[len(c) for c in columns.values() if isinstance(c, np.ndarray)]])
    made = {c: columns.get(c, 0) for c in _ASKED}
    arrays = [pa.array(v if isinstance(v, np.ndarray) else np.full(n, v), kind) for v, kind in zip(made.values(), _ASKED.values())]
    return pa.table([*[pa.repeat(v, n) for v in keys.values()], *arrays], names=[*keys, *made])


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each span, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class _Block:
    """What a block's rows have of their own: values in order of position, and for each asking row how many of these it may know."""

    def __init__(self, t: pa.Table, block: int, value: str, x: str, lag: int, order: str, size: int):
        o, v = t[order].cast(pa.int64()).to_numpy(), _numbers(t, value)
        self.rows = np.flatnonzero(t["_own"].to_numpy(zero_copy_only=False).astype(bool))
        at = np.flatnonzero(~np.isnan(v) & (o // size == block))
        at = at[np.argsort(o[at])]
        self.o, self.v = o[at], v[at]
        self.hi = np.searchsorted(self.o, o[self.rows] - lag, "right")
        self.due = o[self.rows] >= lag
        self.x = _numbers(t, x)[self.rows]
        self.asked = np.flatnonzero(self.due & ~np.isnan(self.x))
        #: A value is asked for once, however many rows have it.
        self.unique, self.back = np.unique(self.x[self.asked], return_inverse=True)


def _expanding_in_blocks(rows: DataFrame, name: str, value: str, x: str, lag: int, keys: Sequence[str], order: str, levels: Sequence[float], size: int) -> DataFrame:
    """rows with the columns of one name.

    Values get a rank in their series, and buckets of `size` ranks. A block of positions knows how many earlier values each bucket has, so it finds for every
    row the bucket that a quantile lies in, and the place in there. Quantiles of neighbouring rows are neighbours too: the block asks a bucket for one slice of its
    earlier values, which all its rows share, and puts its own values between them. So what is asked and answered is a row for a row's rank and few for all
    its quantiles, also where every block asks the same bucket. Values that are equal are in order of position throughout.
    """
    kinds, keys, names = dict(rows.dtypes), list(keys), rows.columns
    by = [*keys, "_block"]
    key_kinds = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    at = lambda shift: F.greatest(F.floor((F.col(order).cast("long") - shift) / size), F.lit(0)).cast("long")
    v = F.col(value).cast("double")
    vals = rows.where(v.isNotNull() & ~F.isnan(v)).select(*keys, F.col(order).cast("long").alias("o"), v.alias("v"))
    vals = placed(vals, ["v", "o"], keys, "rank").withColumns({"b": F.floor(F.col("o") / size).cast("long"), "u": F.floor(F.col("rank") / size).cast("long")})
    # Values of each bucket in all blocks before: a grid of as many rows and columns as there are blocks.
    counts = kept(vals.groupBy(*keys, "b", "u").agg(F.count(F.lit(1)).alias("n")))
    dims = rows.groupBy(*keys).agg(F.max(at(lag)).alias("_b")).join(counts.groupBy(*keys).agg(F.max("u").alias("_u")), keys)
    grid = dims.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), "_b")).alias("b"), "_u").select(*keys, "b", F.explode(F.sequence(F.lit(0).cast("long"), "_u")).alias("u"))
    counted = grid.join(counts, [*keys, "b", "u"], "left")
    earlier = Window.partitionBy(*keys, "u").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    in_order = lambda *c: F.array_sort(F.collect_list(F.struct("u", *c)))
    carry = counted.withColumn("c", F.coalesce(F.sum("n").over(earlier), F.lit(0))).groupBy(*keys, F.col("b").alias("_block")).agg(in_order("c")["c"].alias("carry"))
    least = vals.where(F.col("rank") % size == 0).select(*keys, "u", "v", "o").groupBy(*keys).agg(in_order("v", "o").alias("least"))
    heads = kept(carry.join(least.select(*keys, F.col("least.v").alias("least_v"), F.col("least.o").alias("least_o")), keys))
    # A row goes where the last row that it may know is, and, for its value, to its own block.
    dealt = rows.withColumn("_block", F.explode(F.sequence(at(lag), at(0)))).withColumn("_own", F.col("_block") == at(lag))

    def route(key: tuple[pa.Scalar, ...], have: pa.Table, head: pa.Table) -> pa.Table:
        named, block = dict(zip(keys, key)), key[-1].as_py()
        if not head.num_rows:
            return _asks(named)
        carry, edge, edge_o = (head[c].combine_chunks().flatten().to_numpy() for c in ("carry", "least_v", "least_o"))
        base = np.concatenate([[0], np.cumsum(carry)])
        b = _Block(have, block, value, x, lag, order, size)
        # The bucket of an own value: how many buckets begin at or before it.
        n = len(edge)
        sort = np.lexsort((np.repeat([0, 1], [n, len(b.v)]), np.concatenate([edge_o, b.o]), np.concatenate([edge, b.v])))
        u = np.empty(len(sort), dtype=np.int64)
        u[sort] = np.cumsum(sort < n) - 1
        own_u, bits = u[n:], max(1, n.bit_length())
        more = np.concatenate([base, np.full((1 << bits) - n, base[-1])])
        some = np.flatnonzero(b.due & (b.hi + base[-1] > 0))
        k, _ = places(b.hi[some] + base[-1], levels)
        hi = np.repeat(b.hi[some], k.shape[1])
        at, place = Wavelet(own_u, bits).kth(np.zeros_like(hi), hi, k.ravel(), more)
        # Per bucket the earlier values between the least and the largest place, whatever share of the places is the block's own; one more on either side.
        first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        np.minimum.at(first, at, place)
        np.maximum.at(last, at, place)
        u = np.flatnonzero(last >= 0)
        first = np.maximum(first[u] - np.bincount(own_u, minlength=n)[u] - 1, 0)
        slices = _asks(named, _block=block, u=u, i=-1, y=edge[u], o=edge_o[u], k=first, k_end=np.minimum(last[u] + 2, carry[u]), base=base[u], total=int(base[-1]))
        mine = np.searchsorted(edge, b.unique, "right") - 1
        i = np.flatnonzero(mine >= 0)
        return pa.concat_tables([slices, _asks(named, _block=block, u=mine[i], i=i, y=b.unique[i], base=base[mine[i]])])

    def found(key: tuple[pa.Scalar, ...], have: pa.Table, ask: pa.Table) -> pa.Table:
        o, v, named = have["o"].to_numpy(), have["v"].to_numpy(), dict(zip(keys, key))
        sort = np.argsort(o)
        o, v = o[sort], v[sort]
        s, place = Sorted(v), o[np.argsort(v, kind="stable")]
        c = {n: ask[n].to_numpy() for n in _ASKED}
        before, q = np.searchsorted(o, c["_block"] * size, "left"), c["i"] >= 0
        counts = c["base"][q] + s.below(np.zeros_like(before[q]), before[q], c["y"][q], equal=True)
        m = {n: y[~q] for n, y in c.items()}
        long = np.maximum(m["k_end"] - m["k"], 0)
        hi = np.repeat(before[~q], long)
        rank, _ = s.wavelet.kth(np.zeros_like(hi), hi, _spans(m["k"], long))
        # A slice begins with its bucket, or with its first value.
        begun = m["k"] > 0
        first = rank[(np.cumsum(long) - long)[begun]]
        m["y"][begun], m["o"][begun], m["base"] = s.values[first], place[first], m["base"] + m["k"]
        values = _asks(named, _block=np.repeat(m["_block"], long), u=np.repeat(m["u"], long), i=-2, y=s.values[rank], o=place[rank])
        return pa.concat_tables([_asks(named, _block=c["_block"][q], i=c["i"][q], k=counts), values, _asks(named, **m)])

    def joined(key: tuple[pa.Scalar, ...], have: pa.Table, got: pa.Table) -> pa.Table:
        b = _Block(have, key[-1].as_py(), value, x, lag, order, size)
        c = {n: got[n].to_numpy() for n in _ASKED}
        slices = np.flatnonzero(c["i"] == -1)
        slices = slices[np.argsort(c["u"][slices])]
        values, counts = np.flatnonzero(c["i"] == -2), np.flatnonzero(c["i"] >= 0)
        total = int(c["total"][slices[0]]) if len(slices) else 0
        # Own values, values of slices, and before each slice all earlier values that are in none, as one cell.
        long = np.maximum(c["k_end"] - c["k"], 0)[slices]
        gaps = c["base"][slices] - np.concatenate([[0], (c["base"][slices] + long)[:-1]]) if len(slices) else np.zeros(0, dtype=np.int64)
        n, theirs = len(b.v), np.concatenate([values, slices])
        v, o = np.concatenate([b.v, c["y"][theirs]]), np.concatenate([b.o, c["o"][theirs]])
        sort = np.lexsort((np.repeat([1, 1, 0], [n, len(values), len(slices)]), o, v))
        cell = np.empty(len(sort), dtype=np.int64)
        cell[sort] = np.arange(len(sort))
        weights = np.concatenate([np.zeros(n, dtype=np.int64), np.ones(len(values), dtype=np.int64), gaps])[sort]
        v, bits = v[sort], max(1, len(sort).bit_length())
        more = np.cumsum(np.concatenate([[0], weights, np.zeros((1 << bits) - len(sort), dtype=np.int64)]))
        w = Wavelet(cell[:n], bits)
        m = np.where(b.due, b.hi + total, 0)
        some, q = np.flatnonzero(m > 0), np.full((len(m), len(levels)), np.nan)
        for i in range(0, len(some), AT_ONCE):
            part = some[i : i + AT_ONCE]
            k, share = places(m[part], levels)
            hi = np.repeat(b.hi[part], k.shape[1])
            q[part] = between(v[w.kth(np.zeros_like(hi), hi, k.ravel(), more)[0]].reshape(k.shape), share)
        earlier = np.zeros(len(b.unique), dtype=np.int64)
        earlier[c["i"][counts]] = c["k"][counts]
        below, hi = np.full(len(m), np.nan), b.hi[b.asked]
        here = w.below(np.zeros_like(hi), hi, np.searchsorted(v, b.x[b.asked], "right"))
        below[b.asked] = (earlier[b.back] + here) / np.maximum(m[b.asked], 1)
        none = (m == 0) | np.isnan(b.x)
        made = {f"{name}_q": _lists(q), f"{name}_below": pa.array(below, mask=none), f"{name}_n": pa.array(m)}
        t = have.take(pa.array(b.rows))
        return pa.table([*[t[c] for c in names], *made.values()], names=[*names, *made])

    routed = dealt.groupBy(*by).cogroup(heads.groupBy(*by)).applyInArrow(route, f"{key_kinds}, {_ASKED_KINDS}")
    got = vals.select(*keys, "u", "o", "v").groupBy(*keys, "u").cogroup(routed.groupBy(*keys, "u")).applyInArrow(found, f"{key_kinds}, {_ASKED_KINDS}")
    out_kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return dealt.groupBy(*by).cogroup(got.groupBy(*by)).applyInArrow(joined, f"{out_kinds}, {name}_q array<double>, {name}_below double, {name}_n long")


def sliding(rows: DataFrame, value: str, n: int, levels: Sequence[float], keys: Sequence[str] = SERIES, order: str = "pos", blocks: int = BLOCK) -> DataFrame:
    """rows with, over the last n values (this row's included), _q: quantiles at the levels, and _below: the share of the n - 1 before that are below this
    one; null unless all n are there. order: positions without gaps.

    A task has blocks of positions and the n - 1 rows before each.
    """
    return slid(haloed(rows, blocks, before=n - 1, pos=order), value, n, levels, keys, order)


def slid(dealt: DataFrame, value: str, n: int, levels: Sequence[float], keys: Sequence[str] = SERIES, order: str = "pos") -> DataFrame:
    """sliding() of rows that are haloed already, with n - 1 rows before at least; a row once again."""

    def run(t: pa.Table) -> dict[str, pa.Array]:
        v = _numbers(t, value)
        s, hi = Sorted(v), np.arange(1, t.num_rows + 1)
        lo = np.maximum(hi - n, 0)
        asked = t["_own"].to_numpy(zero_copy_only=False).astype(bool) & (hi >= n) & (s.counts(lo, hi) == n)
        at = np.flatnonzero(asked)
        q, below = np.full((t.num_rows, len(levels)), np.nan), np.zeros(t.num_rows)
        q[at] = s.quantiles(lo[at], hi[at], levels)
        below[at] = s.below(lo[at], hi[at] - 1, v[at], equal=False) / max(n - 1, 1)
        return {"_q": _lists(q), "_below": pa.array(below, mask=~asked)}

    return _by_series(dealt, [*keys, "_block"], order, run, "_q array<double>, _below double").where("_own").drop("_block", "_own")
