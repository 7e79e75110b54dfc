"""Exact Euclidean distance transforms of grids in any number of dimensions, axis by axis, without a reach.

The squared distance to the nearest feature is, along each axis in turn, the lower envelope of parabolas that stand on what
the axes before gave. The first axis makes lines dense; from then on rows are blocks of some cells of that axis, so that a
group (all blocks of one line of the next axis) is as many rows as the grid is long, and its envelopes are found for all of
a block's cells together. No group depends on how many features there are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import half_even

#: Cells of the last axis in a row.
BLOCK = 64


def envelope(p: np.ndarray, g: np.ndarray, q: np.ndarray, weight: float, which: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """(len(q), columns): least of g[k] + weight * (q - p[k])**2 over k, for each place of q and column of g; p and q ascend.

    ``which``: also the k that gives it, the least of equals.

    The k that gives the least moves up with q. Places are solved from coarse to fine: each only looks between the k of its
    solved neighbours, so a level takes one pass over p and q.
    """
    n, columns = g.shape
    best, value = np.zeros((len(q), columns), np.int64), np.empty((len(q), columns))
    step = 1 << max(0, len(q).bit_length() - 1)
    while step:
        at = np.arange(step - 1, len(q), 2 * step)
        low = np.where((at >= step)[:, None], best[np.maximum(at - step, 0)], 0)
        high = np.where((at + step < len(q))[:, None], best[np.minimum(at + step, len(q) - 1)], n - 1)
        size = (high - low + 1).ravel()
        start = np.cumsum(size) - size
        k = np.arange(size.sum()) - np.repeat(start - low.ravel(), size)
        column = np.repeat(np.tile(np.arange(columns), len(at)), size)
        offer = g[k, column] + weight * (np.repeat(np.repeat(q[at], columns), size) - p[k]) ** 2
        least = np.minimum.reduceat(offer, start)
        first = np.minimum.reduceat(np.where(offer == np.repeat(least, size), k, n), start)
        value[at], best[at] = least.reshape(len(at), columns), first.reshape(len(at), columns)
        step //= 2
    return (value, best) if which else value


def _repeated(table: pa.Table, names: list[str], rows: int) -> list[pa.Array]:
    return [table.column(c).take(pa.array(np.zeros(rows, np.int64))) for c in names]


def _squares(lines: DataFrame, keys: list[str], coords: list[str], extent: dict[str, tuple[int, int]], spacing: dict[str, float]) -> DataFrame:
    """keys, coords without the last, block, g: squared distances of blocks of the last axis' cells, from ``lines`` (keys, coords but the last, at: array of places)."""
    last, others = coords[-1], [*keys, *coords[:-1]]
    kinds = dict(lines.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in others], "block bigint", "g array<double>"])
    lo, hi = extent[last]
    places = np.arange(lo, hi)
    starts = np.arange(0, hi - lo, BLOCK)

    def dense(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i, at in enumerate(table.column("at")):
                p = np.sort(np.array(at.as_py()))
                after = np.searchsorted(p, places)
                near = np.minimum(np.abs(places - p[np.maximum(after - 1, 0)]), np.abs(p[np.minimum(after, len(p) - 1)] - places))
                g = (spacing[last] * near) ** 2
                ends = np.append(starts, len(places)).astype(np.int32)
                row = table.slice(i, 1)
                yield pa.record_batch([*[c.combine_chunks() for c in _repeated(row, others, len(starts))], pa.array(starts // BLOCK), pa.ListArray.from_arrays(ends, pa.array(g))], names=[*others, "block", "g"])

    rows = lines.where(F.size("at") > 0).select(*others, "at").mapInArrow(dense, schema)
    for axis in reversed(coords[:-1]):
        rest = [c for c in others if c != axis] + ["block"]
        rows = rows.groupBy(*rest).applyInArrow(_along(axis, rest, extent[axis], spacing[axis], [*others, "block", "g"]), schema)
    return rows


def _along(axis: str, rest: list[str], extent: tuple[int, int], spacing: float, names: list[str]):
    """A group function: the envelope of a line of blocks along an axis."""

    def run(table: pa.Table) -> pa.Table:
        p = table.column(axis).to_numpy()
        order, q = np.argsort(p), np.arange(*extent)
        g = table.column("g").combine_chunks().flatten().to_numpy().reshape(len(p), -1)[order]
        out = envelope(p[order].astype(float), g, q.astype(float), spacing**2)
        made = dict(zip(rest, _repeated(table, rest, len(q)), strict=True))
        made[axis] = pa.array(q).cast(table.schema.field(axis).type)
        made["g"] = pa.ListArray.from_arrays((np.arange(len(q) + 1) * out.shape[1]).astype(np.int32), pa.array(out.ravel()))
        return pa.table([made[c] for c in names], names=names)

    return run


def _cells(squares: DataFrame, keys: list[str], coords: list[str], extent: dict[str, tuple[int, int]], name: str) -> DataFrame:
    d = squares.select(*keys, *coords[:-1], "block", F.posexplode("g").alias("__i", "__g"))
    return d.select(*keys, *coords[:-1], (F.col("block") * BLOCK + F.col("__i") + extent[coords[-1]][0]).alias(coords[-1]), F.sqrt("__g").alias(name))


def distances(features: DataFrame, coords: list[str], extent: dict[str, tuple[int, int]], keys: list[str] | None = None, spacing: dict[str, float] | None = None) -> DataFrame:
    """keys, coords, distance: for every cell of the grid (coords in [lo, hi) of ``extent``), how far the nearest feature is.

    ``features`` (keys, integer coords) are cells; those outside the extent, or with a null, count nothing, repeated ones
    once. A key without features has no rows. ``spacing``: the pitch of each axis, 1 by default.
    """
    keys, spacing = keys or [], {c: float((spacing or {}).get(c, 1)) for c in coords}
    inside = reduce(lambda a, b: a & b, [(F.col(c) >= extent[c][0]) & (F.col(c) < extent[c][1]) for c in coords])
    lines = features.where(inside).groupBy(*keys, *[F.col(c).cast("bigint").alias(c) for c in coords[:-1]]).agg(F.collect_set(F.col(coords[-1]).cast("bigint")).alias("at"))
    return _cells(_squares(lines, keys, coords, extent, spacing), keys, coords, extent, "distance")


def signed_distances(mask: DataFrame, coords: list[str], extent: dict[str, tuple[int, int]], spacing: dict[str, float] | None = None) -> DataFrame:
    """coords, distance: to the nearest cell of the mask outside of it, minus that to the nearest other cell inside; for every cell of the grid.

    Infinite where the mask is empty, minus infinite where it is all of the grid.
    """
    spacing = {c: float((spacing or {}).get(c, 1)) for c in coords}
    spark, (last, (lo, hi)) = mask.sparkSession, (coords[-1], (extent[coords[-1]]))
    every = spark.range(1).select()
    for c in coords[:-1]:
        every = every.withColumn(c, F.explode(F.sequence(F.lit(extent[c][0]).cast("bigint"), F.lit(extent[c][1] - 1).cast("bigint"))))
    inside = reduce(lambda a, b: a & b, [(F.col(c) >= extent[c][0]) & (F.col(c) < extent[c][1]) for c in coords])
    on = mask.where(inside).groupBy(*[F.col(c).cast("bigint").alias(c) for c in coords[:-1]]).agg(F.collect_set(F.col(last).cast("bigint")).alias("at"))
    lines = every.join(on, coords[:-1], "left") if coords[:-1] else on
    off = lines.withColumn("at", F.array_except(F.sequence(F.lit(lo).cast("bigint"), F.lit(hi - 1).cast("bigint")), F.coalesce("at", F.array().cast("array<bigint>"))))
    out = _cells(_squares(on, [], coords, extent, spacing), [], coords, extent, "outside")
    into = _cells(_squares(off, [], coords, extent, spacing), [], coords, extent, "within")
    cells = out.join(into, coords, "full_outer")
    endless = F.lit(float("inf"))
    return cells.select(*coords, (F.coalesce("outside", endless) - F.coalesce("within", endless)).alias("distance"))


def encoded(distance: Column, unit: float, cap: int = 127, offset: int = 128) -> Column:
    """A signed distance as a byte: rounded half to even in units, up to ``cap`` either way, around ``offset``; infinite ones are at the caps."""
    steps = F.when(distance.isin(float("inf"), float("-inf")), F.signum(distance) * cap).otherwise(half_even(distance / unit))
    return (F.greatest(F.lit(-cap), F.least(F.lit(cap), steps)) + offset).cast("int")


def normals(field: DataFrame, coords: list[str], value: str) -> DataFrame:
    """``field`` (all cells of a grid) with n_<axis>: the unit vector along which ``value`` grows, by central differences, one-sided at the ends; null where it does not."""
    d = field
    for c in coords:
        w = Window.partitionBy(*[k for k in coords if k != c]).orderBy(c)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        here = F.col(value)
        d = d.withColumn(f"__{c}", (F.coalesce(after, here) - F.coalesce(before, here)) / F.greatest(after.isNotNull().cast("int") + before.isNotNull().cast("int"), F.lit(1)))
    size = F.sqrt(sum((F.col(f"__{c}") * F.col(f"__{c}") for c in coords), F.lit(0.0)))
    d = d.withColumn("__size", size)
    return d.select(*field.columns, *[F.when(F.col("__size") > 0, F.col(f"__{c}") / F.col("__size")).alias(f"n_{c}") for c in coords])
