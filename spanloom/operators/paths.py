"""Paths over one surface's squares, or over two that are stitched where they lie on each other. A surface, or a pair, is one group."""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, raster, surfaces


def _tree(near, start) -> tuple[dict, dict]:
    """Least costs from ``start``, and the node before each; of equal ways the one over the least nodes. ``near``: a node's neighbours and costs."""
    cost, before, heap, done = {start: 0.0}, {start: None}, [(0.0, start)], set()
    while heap:
        c, a = heapq.heappop(heap)
        if a in done:
            continue
        done.add(a)
        for b, w in near(a):
            d = c + w
            if b not in done and (d < cost.get(b, math.inf) - 1e-12 or abs(d - cost.get(b, math.inf)) <= 1e-12 and a < before[b]):
                cost[b], before[b] = d, a
                heapq.heappush(heap, (d, b))
    return cost, before


def _back(before: dict, end) -> list:
    out = [end]
    while before[out[-1]] is not None:
        out.append(before[out[-1]])
    return out[::-1]


_MOVES = [(a, b, 1.0 if a == 0 or b == 0 else 2**0.5) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def _grid_edges(cells: set) -> dict:
    return {c: [((c[0] + a, c[1] + b), w) for a, b, w in _MOVES if (c[0] + a, c[1] + b) in cells] for c in cells}


def _gaps(cells: np.ndarray, to: np.ndarray) -> np.ndarray:
    """How far each of the cells is from the nearest of the cells ``to``: line by line along the axis with the fewer lines, not pair by pair."""
    across = int(len(np.unique(to[:, 0])) > len(np.unique(to[:, 1])))
    lines, place, at = to[:, across], to[:, 1 - across], cells[:, 1 - across]
    order = np.lexsort((place, lines))
    lines, place = lines[order], place[order]
    names, begin = np.unique(lines, return_index=True)
    best = np.full(len(cells), np.iinfo("int64").max)
    for name, line in zip(names, np.split(place, begin[1:]), strict=True):
        k = np.searchsorted(line, at)
        gap = np.minimum(np.abs(line[np.minimum(k, len(line) - 1)] - at), np.abs(at - line[np.maximum(k - 1, 0)]))
        best = np.minimum(best, gap**2 + (cells[:, across] - name) ** 2)
    return np.sqrt(best)


def cone_paths(cells: DataFrame, key: str, i: str, j: str, anchors: DataFrame, n: int, seed: str) -> DataFrame:
    """key, anchor_i, anchor_j, cone, rank, length, path (array of i, j): ``n`` ways from each anchor into each of four cones.

    Cones are right, left, down and up of the anchor, their edges included. A way is the shortest over sides and corners; its
    end is drawn, by a seeded hash and the square of its distance, from the cone's cells at least half as far as its farthest
    (all reachable ones where the cone has none). Fewer ends than ``n`` come again; an anchor that nothing can be reached
    from has one way in each cone: itself. Anchors that are no cells have none. A key's cells are one group.
    """
    kinds = dict(cells.dtypes)

    def walk(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        here = set(zip(rows.loc[~rows["__anchor"], i].astype(int), rows.loc[~rows["__anchor"], j].astype(int), strict=True))
        edges, out = _grid_edges(here), []
        for a in sorted(set(zip(rows.loc[rows["__anchor"], i].astype(int), rows.loc[rows["__anchor"], j].astype(int), strict=True)) & here):
            cost, before = _tree(lambda c: edges.get(c, ()), a)
            far = {c: d for c, d in cost.items() if d > 0}
            cones = [
                {c for c in far if c[1] - a[1] >= abs(c[0] - a[0])}, {c for c in far if a[1] - c[1] >= abs(c[0] - a[0])},
                {c for c in far if c[0] - a[0] >= abs(c[1] - a[1])}, {c for c in far if a[0] - c[0] >= abs(c[1] - a[1])},
            ]
            for k, cone in enumerate(cones):
                ends = cone or set(far)
                most = max((far[c] for c in ends), default=0.0)

                def draw(c, k=k):
                    h = hashlib.md5(f"{seed}:{group[0]}:{a[0]}:{a[1]}:{k}:{c[0]}:{c[1]}".encode()).hexdigest()[:15]
                    return -math.log((int(h, 16) + 1) / 2**60) / far[c] ** 2, c

                chosen = sorted((c for c in ends if far[c] >= 0.5 * most), key=draw)[:n] or [a]
                for r in range(n if far else 1):
                    path = _back(before, chosen[r % len(chosen)])
                    out.append((group[0], *a, k, r, float(cost[path[-1]]), [{"i": int(y), "j": int(x)} for y, x in path]))
        return pd.DataFrame(out, columns=[key, "anchor_i", "anchor_j", "cone", "rank", "length", "path"], dtype=object)

    both = cells.select(key, i, j, F.lit(False).alias("__anchor")).unionByName(anchors.select(key, i, j, F.lit(True).alias("__anchor")))
    schema = f"{key} {kinds[key]}, anchor_i bigint, anchor_j bigint, cone int, rank int, length double, path array<struct<i: bigint, j: bigint>>"
    return both.groupBy(key).applyInPandas(walk, schema)


def stitched_paths(vertices: DataFrame, surface: str, i: str, j: str, coords: list[str], pairs: DataFrame, radius: float, margin: float, cell: float | None = None) -> DataFrame:
    """a, b, rank, on, i, j, z, y, x: for each pair of surfaces that lie on each other, a way from a's own part into b's.

    Nodes are the squares of both; steps go to neighbours, and, at cost 1, between a square and the one that its centre lands
    on, either way. Squares that land, or are landed on, are shared. The way begins in a and ends in b at the square outside
    of the shared part whose distance to that is nearest above ``margin`` (ties: the first), or else at the first square
    outside; b's must be reachable. Pairs without a shared part, or with nothing outside of it on one side, have none.
    """
    land = graph.cut_lineage(surfaces.landings(vertices, surface, i, j, coords, pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), radius, cell))
    centre = graph.cut_lineage(surfaces.square_centres(vertices, [surface], i, j, coords).select(F.col(surface).alias("on"), F.col(i).alias("i"), F.col(j).alias("j"), "z", "y", "x"))
    quads = pairs.join(centre, (F.col("on") == F.col("a")) | (F.col("on") == F.col("b")))
    bridge = lambda a, b: pairs.join(land.select(F.col("a").alias(a), "i", "j", F.col("b").alias(b), "to_i", "to_j"), ["a", "b"]).select("a", "b", F.col(a).alias("on"), "i", "j", "to_i", "to_j")
    none = F.lit(None).cast("bigint")
    rows = quads.select("a", "b", "on", "i", "j", "z", "y", "x", none.alias("to_i"), none.alias("to_j"))
    steps = bridge("a", "b").unionByName(bridge("b", "a"))
    rows = rows.unionByName(steps, allowMissingColumns=True)

    def connect(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = group
        names = ["a", "b", "rank", "on", "i", "j", "z", "y", "x"]
        own = rows[rows["to_i"].isna()]
        place = {(int(s == b), int(y), int(x)): (z, cy, cx) for s, y, x, z, cy, cx in zip(own["on"], own["i"], own["j"], own["z"], own["y"], own["x"], strict=True)}
        over = [((int(s == b), int(y), int(x)), (int(s != b), int(p), int(q))) for s, y, x, p, q in rows.loc[~rows["to_i"].isna(), ["on", "i", "j", "to_i", "to_j"]].itertuples(index=False)]
        over = [(u, v) for u, v in over if u in place and v in place]
        bridges: dict = {}
        for u, v in over:
            bridges.setdefault(u, []).append((v, 1.0))
            bridges.setdefault(v, []).append((u, 1.0))

        def near(c):
            k, y, x = c
            return [(q, w) for q, w in (((k, y + p, x + r), w) for p, r, w in _MOVES) if q in place] + bridges.get(c, [])

        shared = {c for step in over for c in step}

        def end(k: int, reached=None):
            outside = sorted(c for c in place if c[0] == k and c not in shared and (reached is None or c in reached))
            common = [c for c in shared if c[0] == k]
            if not outside or not common:
                return None
            far = _gaps(np.array([c[1:] for c in outside], "int64"), np.array([c[1:] for c in common], "int64"))
            deep = np.flatnonzero(far >= margin)
            return outside[deep[np.argmin(far[deep])]] if len(deep) else outside[0]

        start = end(0)
        if start is None:
            return pd.DataFrame(columns=names, dtype=object)
        cost, before = _tree(near, start)
        last = end(1, cost)
        path = _back(before, last) if last is not None else []
        return pd.DataFrame([(a, b, r, (a, b)[c[0]], c[1], c[2], *place[c]) for r, c in enumerate(path)], columns=names, dtype=object)

    kind = dict(vertices.dtypes)[surface]
    return rows.groupBy("a", "b").applyInPandas(connect, f"a {kind}, b {kind}, rank bigint, on {kind}, i bigint, j bigint, z double, y double, x double")


def largest_part(cells: DataFrame, key: str, i: str, j: str) -> DataFrame:
    """The cells of each key's largest stretch over sides; of equals that with the first cell."""
    c = cells.select(key, F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j")).distinct()
    node = F.struct(key, "i", "j")
    near = raster.neighbours(c.withColumn("from", node), ["i", "j"], 1, faces_only=True).select("from", node.alias("to")).where("from < to")
    parts = graph.components(near.join(c.select(node.alias("to")), "to"), "from", "to")
    own = c.join(parts.select(F.col("node").alias("n"), "root"), node == F.col("n"), "left").select(key, "i", "j", F.coalesce("root", node).alias("root"))
    best = own.groupBy(key, "root").agg(F.count("*").alias("n")).groupBy(key).agg(F.min_by("root", F.struct(-F.col("n"), F.col("root"))).alias("root"))
    return own.join(best, [key, "root"]).select(key, F.col("i").alias(i), F.col("j").alias(j))
