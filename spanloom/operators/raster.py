"""Cells of grids in rows: neighbourhoods by offsets and equal keys, pooling by floor division."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neighbours(cells: DataFrame, coords: list[str], reach: int = 1, faces_only: bool = False) -> DataFrame:
    """Each cell's row once for each offset within ``reach``, its coordinates moved there; others kept."""
    moves = [m for m in itertools.product(range(-reach, reach + 1), repeat=len(coords)) if not faces_only or sum(map(abs, m)) <= 1]
    d = cells.withColumn("__m", F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(m, coords, strict=True)]) for m in moves])))
    for c in coords:
        d = d.withColumn(c, F.col(c) + F.col(f"__m.{c}"))
    return d.drop("__m")


def splat_max(cells: DataFrame, coords: list[str], value: str, reach: int = 1, onto: DataFrame | None = None) -> DataFrame:
    """The largest value in each cell's neighbourhood; ``onto``: only these cells."""
    out = neighbours(cells, coords, reach).groupBy(*coords).agg(F.max(value).alias(value))
    return out if onto is None else out.join(onto.select(*coords).distinct(), coords, "left_semi")


def face_neighbours_on(cells: DataFrame, coords: list[str]) -> DataFrame:
    """``cells`` (distinct) with n: how many of the face neighbours are cells too."""
    others = neighbours(cells.select(*coords), coords, 1, faces_only=True)
    return others.groupBy(*coords).agg((F.count("*") - 1).alias("n")).join(cells.select(*coords), coords, "left_semi")


def boundary(cells: DataFrame, coords: list[str]) -> DataFrame:
    """Cells with a face neighbour that is none."""
    return face_neighbours_on(cells, coords).where(F.col("n") < 2 * len(coords)).select(*coords)


def eroded(cells: DataFrame, coords: list[str], times: int) -> DataFrame:
    """Cells left after taking the boundary off ``times`` times."""
    for _ in range(times):
        cells = face_neighbours_on(cells, coords).where(F.col("n") == 2 * len(coords)).select(*coords)
    return cells


def valid_quads(vertices: DataFrame, i: str, j: str, keys: list[str]) -> DataFrame:
    """Squares whose four corners are vertices: each vertex votes for the four squares that it is a corner of."""
    v = vertices.select(*keys, i, j).distinct()
    d = v.withColumn("__m", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])))
    d = d.withColumn(i, F.col(i) - F.col("__m.a")).withColumn(j, F.col(j) - F.col("__m.b"))
    return d.groupBy(*keys, i, j).agg(F.count("*").alias("corners")).where("corners = 4").select(*keys, i, j)


def bilinear(points: DataFrame, grid: DataFrame, keys: list[str], i: str, j: str, value: str) -> DataFrame:
    """``points`` at fractional (i, j) with the value between the four grid cells around; null if one is missing."""
    fi, fj = F.col(i) - F.floor(i), F.col(j) - F.floor(j)
    corner = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), ((fi if a else 1 - fi) * (fj if b else 1 - fj)).alias("w")) for a in (0, 1) for b in (0, 1)]
    p = points.withColumn("__c", F.explode(F.filter(F.array(*corner), lambda c: c["w"] > 0)))
    p = p.withColumn("__i", F.floor(i) + F.col("__c.a")).withColumn("__j", F.floor(j) + F.col("__c.b"))
    g = grid.select(*keys, F.col(i).alias("__i"), F.col(j).alias("__j"), F.col(value).alias("__v"))
    out = p.join(g, [*keys, "__i", "__j"], "left").groupBy(*points.columns)
    return out.agg(F.when(F.count("__v") == F.count("*"), F.sum(F.col("__c.w") * F.col("__v"))).alias(value))


def warped(points: DataFrame, image: DataFrame, i: str, j: str, channels: list[str]) -> DataFrame:
    """``points`` at fractional (i, j) with each channel between the four pixels around; null if one of them is missing."""
    fi, fj = F.col(i) - F.floor(i), F.col(j) - F.floor(j)
    corner = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), ((fi if a else 1 - fi) * (fj if b else 1 - fj)).alias("w")) for a in (0, 1) for b in (0, 1)]
    p = points.withColumn("__c", F.explode(F.filter(F.array(*corner), lambda c: c["w"] > 0)))
    p = p.withColumn("__i", F.floor(i) + F.col("__c.a")).withColumn("__j", F.floor(j) + F.col("__c.b"))
    g = image.select(F.col(i).alias("__i"), F.col(j).alias("__j"), *[F.col(c).alias(f"__{c}") for c in channels], F.lit(1).alias("__there"))
    whole = F.count("__there") == F.count("*")
    return p.join(g, ["__i", "__j"], "left").groupBy(*points.columns).agg(*[F.when(whole, F.sum(F.col("__c.w") * F.col(f"__{c}"))).alias(c) for c in channels])


def covered(faces: DataFrame) -> DataFrame:
    """y, x, faces: the whole points of the plane in triangles (corners a, b, c: ``a_y``, ``a_x`` ...), edges included, and how many hold them."""
    span = lambda x: F.sequence(F.ceil(F.least(f"a_{x}", f"b_{x}", f"c_{x}")), F.floor(F.greatest(f"a_{x}", f"b_{x}", f"c_{x}")))
    some = lambda x: F.ceil(F.least(f"a_{x}", f"b_{x}", f"c_{x}")) <= F.floor(F.greatest(f"a_{x}", f"b_{x}", f"c_{x}"))
    d = faces.where(some("y") & some("x")).withColumn("y", F.explode(span("y"))).withColumn("x", F.explode(span("x")))
    side = lambda a, b: (F.col(f"{b}_x") - F.col(f"{a}_x")) * (F.col("y") - F.col(f"{a}_y")) - (F.col(f"{b}_y") - F.col(f"{a}_y")) * (F.col("x") - F.col(f"{a}_x"))
    u = [side("a", "b"), side("b", "c"), side("c", "a")]
    return d.where((F.least(*u) >= 0) | (F.greatest(*u) <= 0)).groupBy("y", "x").agg(F.count("*").alias("faces"))


def pooled(cells: DataFrame, coords: list[str], factor: int, how: Column, extent: dict[str, int] | None = None) -> DataFrame:
    """``how`` over blocks of factor cells along each axis; ``extent``: an unfinished last block is cut off."""
    for c, n in (extent or {}).items():
        cells = cells.where(F.col(c) < n // factor * factor)
    return cells.groupBy(*[F.floor(F.col(c) / factor).alias(c) for c in coords]).agg(how)


def dusted(cells: DataFrame, coords: list[str], least: int, most: int | None = None, faces_only: bool = True) -> DataFrame:
    """Cells of the stretches (over faces, or over corners too) that have ``least`` cells or more, and fewer than ``most``."""
    from .blocks import grid_parts

    own = grid_parts(cells, coords, faces_only)
    size = own.groupBy("root").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.lit(True) if most is None else F.col("n") < most))
    return own.join(size, "root").select(*[F.col(c).cast(kind).alias(c) for c, kind in cells.select(*coords).dtypes])


def thinned(cells: DataFrame, keys: list[str], i: str, j: str) -> DataFrame:
    """The cells' skeleton, one cell wide: boundary cells go, from two sides in turn, where that neither cuts nor shortens a line.

    A cell's eight neighbours are one byte, gathered by a partial aggregate; a round is two of these, and rounds go on until
    none goes: as many as half of the thickest part.
    """
    from .graph import cut_lineage

    # Neighbours in turn, from the one above on: the order that crossings are counted in.
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    now = cut_lineage(cells.select(*keys, i, j).distinct())
    bit = lambda k: F.shiftright("bits", k).bitwiseAND(F.lit(1))
    while True:
        gone = False
        for side in (0, 1):
            votes = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(1 << k).alias("bit")) for k, (a, b) in enumerate(ring)]))
            # A cell at (a, b) from another is that one's neighbour k.
            v = now.withColumn("m", votes).select(*keys, (F.col(i) - F.col("m.a")).alias(i), (F.col(j) - F.col("m.b")).alias(j), F.col("m.bit").alias("bit"))
            d = now.join(v.groupBy(*keys, i, j).agg(F.sum("bit").cast("int").alias("bits")), [*keys, i, j], "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
            n = F.bit_count("bits")
            turns = sum(((1 - bit(k)) * bit((k + 1) % 8) for k in range(8)), F.lit(0))
            p2, p4, p6, p8 = bit(0), bit(2), bit(4), bit(6)
            open_ = (p2 * p4 * p6 == 0) & (p4 * p6 * p8 == 0) if side == 0 else (p2 * p4 * p8 == 0) & (p2 * p6 * p8 == 0)
            left = cut_lineage(d.where(~(n.between(2, 6) & (turns == 1) & open_)).select(*keys, i, j))
            gone |= left.count() < now.count()
            now = left
        if not gone:
            return now


def line_gaps(cells: DataFrame, i: str, j: str, value: str, height: int, window: int, step: int, pitch: tuple[float, float], least: float) -> DataFrame:
    """start, gaps, score: for each window of ``window`` columns, every ``step``, whose mean is ``least`` or more: the gaps between
    the lines of its profile down the rows, and the mean of how well they fit the pitch.

    A profile is the windows' mean of each of ``height`` rows (absent cells are 0), without its slow trend, smoothed; lines
    are its peaks that stand out and are not too near each other. A window's profile is one group: ``height`` numbers.
    """
    import numpy as np
    import pandas as pd

    from ..functions.lines import conformity, peaks, smoothed

    lo, hi = pitch
    first = F.greatest(F.ceil((F.col(j) - (window - 1)) / step), F.lit(0).cast("long"))
    starts = F.filter(F.sequence(first, F.greatest(first, F.floor(F.col(j) / step))), lambda s: s <= F.floor(F.col(j) / step))
    d = cells.where(F.col(i).between(0, height - 1) & (F.col(j) >= 0)).withColumn("start", F.explode(F.transform(starts, lambda s: s * step)))
    rows = d.groupBy("start", i).agg((F.sum(value) / window).alias("__mean"))

    def lines(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        profile = np.zeros(height)
        profile[rows[i].to_numpy(int)] = rows["__mean"].to_numpy(float)
        if profile.mean() < least:
            return pd.DataFrame({"start": [], "gaps": [], "score": []}, dtype=object)
        flat = smoothed(profile - smoothed(profile, 2 * hi), lo / 8)
        gaps = np.diff(peaks(flat, max(1, int(0.3 * lo)), max(0.25 * flat.std(), 0.2 * profile.mean())))
        return pd.DataFrame({"start": [key[0]], "gaps": [gaps.tolist()], "score": [float(np.mean([conformity(g, lo, hi) for g in gaps])) if len(gaps) else None]})

    return rows.groupBy("start").applyInPandas(lines, "start bigint, gaps array<bigint>, score double")


def chunk_of(cells: DataFrame, coords: list[str], size: int) -> DataFrame:
    """Chunk coordinates c_*, and the offset within the chunk in row-major order."""
    d, off = cells, F.lit(0)
    for c in coords:
        d = d.withColumn(f"c_{c}", F.floor(F.col(c) / size))
        off = off * size + F.pmod(F.col(c), F.lit(size))
    return d.withColumn("offset", off.cast("long"))


def round_robin_labels(df: DataFrame, order: str, labels: int = 255) -> DataFrame:
    """``df`` with label: 1 to ``labels`` again and again, in order."""
    from .ragged import numbered

    return numbered(df, [order], "label").withColumn("label", (1 + F.col("label") % labels).cast("long"))
