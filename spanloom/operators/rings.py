"""Tables of bins around a circle: means, filled from the nearest bin, smoothed across the seam, with a confidence."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distance import envelope

#: Columns of bins that are filled together.
BLOCK = 64


def gaussian(sigma: float) -> list[float]:
    """Weights of -r to r that add up to 1; r is four sigma, rounded."""
    if sigma <= 0:
        return [1.0]
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def _nearest_around(bins: int):
    """Rows (i, at, v: places and values on the ring) -> i, block, d, j, v: for each place of the ring the nearest of the row's."""

    def run(batches):
        places = np.arange(bins)
        for batch in batches:
            for i, at, v in zip(batch.column("i").to_pylist(), batch.column("at"), batch.column("v"), strict=True):
                at, v = np.array(at.as_py()), np.array(v.as_py(), float)
                order = np.argsort(at)
                at, v = at[order], v[order]
                # Once around before and after: the nearest to the left and to the right.
                k = np.searchsorted(at, places, "right")
                left, right = (k - 1) % len(at), k % len(at)
                dl, dr = (places - at[left]) % bins, (at[right] - places) % bins
                # Of two as near, the lower bin.
                take = np.where((dl < dr) | (dl == dr) & (at[left] <= at[right]), left, right)
                d, starts = np.minimum(dl, dr), np.arange(0, bins, BLOCK)
                ends = np.append(starts, bins).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (d.astype(float), at[take], v[take])]
                yield pa.record_batch([pa.array(np.full(len(starts), i)), pa.array(starts // BLOCK), *lists], names=["i", "block", "d", "j", "v"])

    return run


def _nearest_along(extent: tuple[int, int]):
    """A group function: of the rows of a block of places, that which is nearest for each row of the table and place."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.column("i").to_numpy()
        order, q = np.argsort(rows), np.arange(*extent)
        matrix = lambda c: table.column(c).combine_chunks().flatten().to_numpy().reshape(len(rows), -1)[order]
        d, j, v = matrix("d"), matrix("j"), matrix("v")
        _, best = envelope(rows[order].astype(float), d**2, q.astype(float), 1.0, True)
        place = np.arange(d.shape[1])
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "i": np.repeat(q, len(place)), "j": np.tile(block * BLOCK + place, len(q)), "from_i": rows[order][best].ravel(),
                "from_j": j[best, place].ravel(), "value": v[best, place].ravel(),
            }
        )

    return run


def filled(bins: DataFrame, extent: tuple[int, int], around: int) -> DataFrame:
    """i, j, from_i, from_j, value: each bin of the table (i in [lo, hi) of ``extent``, j in [0, around)) with the value of the nearest bin that has one.

    ``bins`` (i, j, value). j goes around: bin 0 is next to the last. Of bins as near, that of least i, then j. No bins, no rows.
    """
    there = bins.where((F.col("i") >= extent[0]) & (F.col("i") < extent[1]) & (F.col("j") >= 0) & (F.col("j") < around) & F.col("value").isNotNull())
    both = F.array_sort(F.collect_list(F.struct(F.col("j").cast("bigint").alias("j"), F.col("value").cast("double").alias("v"))))
    rows = there.groupBy(F.col("i").cast("bigint").alias("i")).agg(both.alias("b")).select("i", F.col("b.j").alias("at"), F.col("b.v").alias("v"))
    near = rows.mapInArrow(_nearest_around(around), "i bigint, block bigint, d array<double>, j array<bigint>, v array<double>")
    return near.groupBy("block").applyInArrow(_nearest_along(extent), "i bigint, j bigint, from_i bigint, from_j bigint, value double")


def _smoothed(values: Column, sigma: float, wraps: bool) -> Column:
    """An array's values under a Gaussian window; beyond the ends it goes around, or the end's value stands."""
    weights, n = gaussian(sigma), F.size(values)
    if len(weights) == 1:
        return values
    r = len(weights) // 2
    at = lambda i: F.pmod(i, n) if wraps else F.greatest(F.lit(0), F.least(i, n - 1))
    window = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in zip(range(-r, r + 1), weights, strict=True)])
    return F.transform(values, lambda _, i: F.aggregate(window, F.lit(0.0), lambda acc, o: acc + o["w"] * F.get(values, at(i + o["k"]))))


def smoothed(table: DataFrame, value: str, sigma_i: float, sigma_j: float) -> DataFrame:
    """The dense table's ``value`` under a Gaussian window along i (the ends' values go on) and around j. A row or column of the table is a group."""
    line = lambda by, along: table_.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(along, value))).alias("__l"))
    table_ = table
    for by, along, sigma, wraps in (("j", "i", sigma_i, False), ("i", "j", sigma_j, True)):
        g = line(by, along).select(by, F.col(f"__l.{along}").alias("__at"), _smoothed(F.col(f"__l.{value}"), sigma, wraps).alias("__v"))
        table_ = g.select(by, F.explode(F.arrays_zip("__at", "__v")).alias("__z")).select(by, F.col("__z.__at").alias(along), F.col("__z.__v").alias(value))
    return table_.select("i", "j", value)


def ring_table(points: DataFrame, extent: tuple[int, int], around: int, sigma_i: float, sigma_j: float) -> DataFrame:
    """i, j, n, value, confidence: the mean of each bin's points, empty bins filled from the nearest, all smoothed; and how well
    a bin is supported, its smoothed occupancy as a share of the largest.

    ``points`` (i, j, value), i in ``extent``, j a bin of ``around`` on a circle. No points, no rows.
    """
    bins = points.where(F.col("i").between(extent[0], extent[1] - 1) & F.col("value").isNotNull()).groupBy("i", "j").agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    dense = filled(bins, extent, around).join(bins.select("i", "j", "n"), ["i", "j"], "left")
    dense = dense.select("i", "j", "value", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.when(F.col("n") > 0, 1.0).otherwise(0.0).alias("confidence"))
    value, share = smoothed(dense, "value", sigma_i, sigma_j), smoothed(dense, "confidence", sigma_i, sigma_j)
    top = share.agg(F.max("confidence").alias("top"))
    share = share.join(F.broadcast(top)).select("i", "j", (F.col("confidence") / F.col("top")).alias("confidence"))  # top is one row
    return dense.select("i", "j", "n").join(value, ["i", "j"]).join(share, ["i", "j"])
