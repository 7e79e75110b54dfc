"""Waves and stretches over grids: blocks of cells are solved whole, each with one cell around it, until no edge's labels change.

A round runs blocks apart, so that a wave crosses a block in one round, not in one for each cell. Groups are bounded by
the block, whatever the surface's size. Labels only ever improve, so the order of rounds plays no part in the result.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import wrap
from . import graph

#: Cells of a block, and its longest side where the grid is wide both ways.
AREA, SIDE = 1 << 18, 512


def _sides(cells: DataFrame, i: str, j: str, block: int | None) -> tuple[int, int]:
    """The sides of a block: ``block`` both ways, or else as long as AREA lets them be where the grid is narrow one way."""
    if block:
        return block, block
    r = cells.agg(*[(F.max(c) - F.min(c) + 1).alias(n) for c, n in ((i, "i"), (j, "j"))]).first()
    narrow = max(1, min(SIDE, r["i"] or 1, r["j"] or 1))
    return (AREA // narrow, narrow) if (r["j"] or 1) <= (r["i"] or 1) else (narrow, AREA // narrow)


def settled(cells: DataFrame, i: str, j: str, label: list[str], solve: Callable[[dict, dict], dict], block: int | None = None) -> DataFrame:
    """``cells`` (i, j, label columns, others) with the labels that ``solve`` settles on; cells without one have null labels.

    ``solve``: (rows of a block by place, rows around it by place) -> label tuples by place; rows are tuples in the order
    of the columns. What it gives must not depend on the block's old labels but where those are seeds.
    A round solves the blocks beside whose edges labels have changed, and keeps edges only; the last pass solves all of them.
    """
    names, kinds = cells.columns, dict(cells.dtypes)
    at = [names.index(i), names.index(j)]
    where = [names.index(c) for c in label]
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*names])
    keyed = f"{schema}, __a bigint, __b bigint"
    cells = graph.cut_lineage(cells)
    sides = _sides(cells, i, j, block)

    def kernel(edges_only: bool):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            own, around, full = {}, {}, []
            corner = (int(key[0]), int(key[1]))
            for row in rows[names].astype(object).where(rows[names].notna(), None).itertuples(index=False, name=None):
                place = (int(row[at[0]]), int(row[at[1]]))
                inside = (place[0] // sides[0], place[1] // sides[1]) == corner
                (own if inside else around)[place] = row
            found = solve(own, around)
            for place, row in own.items():
                if edges_only and not any(p % n in (0, n - 1) for p, n in zip(place, sides, strict=True)):
                    continue
                out = list(row)
                for c, v in zip(where, found.get(place, [None] * len(where)), strict=True):
                    out[c] = v
                full.append((*out, *corner))
            return pd.DataFrame(full, columns=[*names, "__a", "__b"])

        return run

    part = lambda c, n: F.floor(c / n).cast("bigint")
    own = graph.cut_lineage(cells.withColumn("__a", part(F.col(i), sides[0])).withColumn("__b", part(F.col(j), sides[1])))
    shift = F.array_distinct(F.array(*[F.struct(part(F.col(i) + a, sides[0]).alias("a"), part(F.col(j) + b, sides[1]).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    others = F.filter(shift, lambda t: (t["a"] != F.col("__a")) | (t["b"] != F.col("__b")))
    beside = lambda d: d.withColumn("__t", F.explode(others)).select(*names, F.col("__t.a").alias("__a"), F.col("__t.b").alias("__b"))
    on_edge = (F.pmod(i, F.lit(sides[0])).isin(0, sides[0] - 1)) | (F.pmod(j, F.lit(sides[1])).isin(0, sides[1] - 1))
    edges, active = graph.cut_lineage(own.where(on_edge)), own.select("__a", "__b").distinct()
    while True:
        rows = own.unionByName(beside(edges)).join(active, ["__a", "__b"], "left_semi")
        new = graph.cut_lineage(rows.groupBy("__a", "__b").applyInPandas(kernel(True), keyed))
        old = edges.select(i, j, F.struct(*label).alias("__old"))
        changed = new.join(old, [i, j]).where(~F.struct(*label).eqNullSafe(F.col("__old"))).select(*new.columns)
        next_ = graph.cut_lineage(beside(changed).select("__a", "__b").distinct())
        edges = graph.cut_lineage(edges.join(active, ["__a", "__b"], "left_anti").unionByName(new))
        if next_.isEmpty():
            break
        active = next_
    return graph.cut_lineage(own.unionByName(beside(edges)).groupBy("__a", "__b").applyInPandas(kernel(False), keyed)).drop("__a", "__b")


def grid_parts(cells: DataFrame, coords: list[str], faces_only: bool) -> DataFrame:
    """coords, root: the least cell (a struct of coords) of each cell's stretch over faces, or over corners too.

    Stretches inside a block are found by its group; those of neighbouring blocks that touch at the edge are connected by
    their least cells, which are few.
    """
    side = max(2, round((AREA // 4) ** (1 / len(coords))))
    moves = [m for m in itertools.product((-1, 0, 1), repeat=len(coords)) if m > (0,) * len(coords) and (not faces_only or sum(map(abs, m)) <= 1)]
    keys = [f"__b{k}" for k in range(len(coords))]
    c = cells.select(*[F.col(x).cast("bigint").alias(x) for x in coords]).dropna().distinct()
    c = c.select(*coords, *[F.floor(F.col(x) / side).cast("bigint").alias(k) for x, k in zip(coords, keys, strict=True)])

    def contract(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows[coords].to_numpy(np.int64)
        p = p[np.lexsort(p.T[::-1])]
        low = p.min(0)
        shape = tuple(p.max(0) - low + 3)
        # A ring of none around, so that no move leaves the array.
        at = np.ravel_multi_index(tuple((p - low + 1).T), shape)
        index = np.full(np.prod(shape), -1)
        index[at] = np.arange(len(p))
        label = np.arange(len(p))
        ends = []
        for m in moves:
            to = index[at + np.ravel_multi_index(tuple(np.array(m) + 1), shape) - np.ravel_multi_index((1,) * len(m), shape)]
            ends.append(np.stack([np.flatnonzero(to >= 0), to[to >= 0]]))
        a, b = np.concatenate(ends, axis=1)
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
        return pd.DataFrame(np.concatenate([p, p[label], p // side], axis=1), columns=[*coords, *[f"__r{k}" for k in range(len(coords))], *keys])

    schema = ", ".join(f"{x} bigint" for x in [*coords, *[f"__r{k}" for k in range(len(coords))], *keys])
    found = c.groupBy(*keys).applyInPandas(contract, schema)
    local = graph.cut_lineage(found.select(*coords, *keys, F.struct(*[F.col(f"__r{k}").alias(x) for k, x in enumerate(coords)]).alias("__root")))
    edge = reduce(lambda a, b: a | b, [F.pmod(x, F.lit(side)).isin(0, side - 1) for x in coords])
    outer = local.where(edge)
    to = F.explode(F.array(*[F.struct(*[(F.col(x) + F.lit(v)).alias(x) for v, x in zip(m, coords, strict=True)]) for m in moves]))
    step = outer.select(F.col("__root").alias("a"), *keys, to.alias("__to"))
    crosses = reduce(lambda a, b: a | b, [F.floor(F.col(f"__to.{x}") / side) != F.col(k) for x, k in zip(coords, keys, strict=True)])
    step = step.where(crosses).select("a", *[F.col(f"__to.{x}").alias(x) for x in coords])
    parts = graph.components(step.join(outer.select(*coords, F.col("__root").alias("b")), coords).select("a", "b"))
    return local.join(parts, F.col("__root") == F.col("node"), "left").select(*coords, F.coalesce("root", "__root").alias("root"))


def _geodesic(own: dict, around: dict) -> dict:
    """Least costs from the seeds and from what lies around; rows end with cost, seed."""
    best = {p: 0.0 for p, r in own.items() if r[-1]}
    heap = [(0.0, p) for p in best]
    heap += [(r[-2], p) for p, r in around.items() if r[-2] is not None]
    heapq.heapify(heap)
    while heap:
        cost, (y, x) = heapq.heappop(heap)
        if cost > best.get((y, x), np.inf):
            continue
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                q = (y + dy, x + dx)
                if q in own and q != (y, x):
                    c = cost + (1.0 if dy == 0 or dx == 0 else 2**0.5)
                    if c < best.get(q, np.inf):
                        best[q] = c
                        heapq.heappush(heap, (c, q))
    return {p: (c,) for p, c in best.items()}


def geodesics(cells: DataFrame, i: str, j: str, seed: str, block: int | None = None) -> DataFrame:
    """i, j, cost: for each cell that is reached, the least length of a walk from a cell whose ``seed`` is true, 1 along a
    side and the square root of 2 over a corner."""
    c = cells.select(i, j, F.lit(None).cast("double").alias("cost"), F.col(seed).alias("__seed"))
    return settled(c, i, j, ["cost"], _geodesic, block).where("cost is not null").select(i, j, "cost")


def _unwrap(own: dict, around: dict) -> dict:
    """Labels (depth, turns) by levels: the least depth, then the least turns, then the least place before. Rows: i, j, angle, seed, depth, turns."""
    best: dict = {}
    heap = [((0, 0, -1, -1), p) for p, r in own.items() if r[3]]
    for p, r in around.items():
        if r[4] is not None:
            heap.append(((int(r[4]), int(r[5]), -1, -1), p))
    heapq.heapify(heap)
    while heap:
        label, p = heapq.heappop(heap)
        if p in own:
            if p in best:
                continue
            best[p] = label
        a = (own.get(p) or around[p])[2]
        for q in ((p[0] - 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1), (p[0] + 1, p[1])):
            if q in own and q not in best:
                jump = own[q][2] - a
                heapq.heappush(heap, ((label[0] + 1, label[1] + int(jump > np.pi) - int(jump < -np.pi), *p), q))
    return {p: label[:2] for p, label in best.items()}


def unwrapped_grid(cells: DataFrame, i: str, j: str, angle: str, block: int | None = None) -> DataFrame:
    """i, j, turns, main: whole turns to add to each cell's angle so that neighbours agree, told from its component's first cell.

    By levels from that cell; in a level the least turns count, then the least neighbour before. ``main``: in the largest
    component (the first of equals).
    """
    place = F.struct(F.col(i).cast("bigint").alias("i"), F.col(j).cast("bigint").alias("j"))
    c = cells.select(place.alias("node"), wrap(angle).alias("a"))
    comp = graph.cut_lineage(grid_parts(c.select("node.*"), ["i", "j"], faces_only=True).select(F.struct("i", "j").alias("node"), "root"))
    none = F.lit(None).cast("bigint")
    seeded = c.join(comp, "node").select(F.col("node.i").alias("i"), F.col("node.j").alias("j"), F.col("a").alias("angle"), (F.col("node") == F.col("root")).alias("seed"), none.alias("depth"), none.alias("turns"))
    done = settled(seeded, "i", "j", ["depth", "turns"], _unwrap, block)
    size = comp.groupBy("root").agg(F.count("*").alias("n"))
    top = size.agg(F.min_by("root", F.struct(-F.col("n"), F.col("root"))).alias("top"))
    out = done.join(comp.select(F.col("node.i").alias("i"), F.col("node.j").alias("j"), "root"), ["i", "j"]).join(F.broadcast(top))  # top is one row
    return out.select(F.col("i").alias(i), F.col("j").alias(j), "turns", (F.col("root") == F.col("top")).alias("main"))
