"""Grids that grow from seeds over a graph of crossing tracks, many at once, a track a round.

A grid has rows (tracks of one family) and columns (of the other), and each row crosses each column. In a round every grid
looks at all tracks that cross all of its columns (or rows), and takes the one that fits best. What a grid may still take is
kept in a table of candidates with where they cross its tracks: a track that is added is met once, by a join that extends
the candidates that cross it and drops those that don't, so a round never goes over the whole graph again.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Tables

_PLACE = ("z", "y", "x")
_NODE = ("own", "on", *_PLACE)


def best_crossings_both_ways(edges: DataFrame, tracks: DataFrame) -> DataFrame:
    """src, dst, on (place along src), own (along dst), z, y, x, clearance: one crossing of each two tracks of different families, both ways.

    Of several crossings, that of most clearance from the four ends, then the first by place.
    """
    t = lambda s: tracks.select(F.col("track").alias(s), F.col("family").alias(f"f_{s}"), F.col("length").alias(f"l_{s}"))
    e = edges.where("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), *[F.when(F.col("a") < F.col("b"), F.struct("pos_a", "pos_b")).otherwise(F.struct(F.col("pos_b").alias("pos_a"), F.col("pos_a").alias("pos_b"))).alias("pos")], *_PLACE)
    e = e.join(t("lo"), "lo").join(t("hi"), "hi").where("f_lo != f_hi")
    e = e.withColumn("clearance", F.least("pos.pos_a", F.col("l_lo") - F.col("pos.pos_a"), "pos.pos_b", F.col("l_hi") - F.col("pos.pos_b")))
    rank = F.struct(-F.col("clearance"), "pos.pos_a", "pos.pos_b", *_PLACE)
    e = e.groupBy("lo", "hi").agg(F.min_by(F.struct("pos", *_PLACE, "clearance"), rank).alias("e"))
    way = lambda s, d, on, own: e.select(F.col(s).alias("src"), F.col(d).alias("dst"), F.col(f"e.pos.{on}").alias("on"), F.col(f"e.pos.{own}").alias("own"), *[f"e.{c}" for c in _PLACE], "e.clearance")
    return way("lo", "hi", "pos_a", "pos_b").unionByName(way("hi", "lo", "pos_b", "pos_a"))


def _node(own: str = "own", on: str = "on") -> Column:
    return F.struct(F.col(own).cast("double").alias("own"), F.col(on).cast("double").alias("on"), *[F.col(c).cast("double").alias(c) for c in _PLACE])


def _flipped(n: Column) -> Column:
    return F.struct(n["on"].alias("own"), n["own"].alias("on"), *[n[c].alias(c) for c in _PLACE])


def _with(items: Column, slot: Column, item: Column) -> Column:
    """The array with one more item at ``slot``."""
    return F.concat(F.slice(items, F.lit(1), slot), F.array(item), F.slice(items, slot + 1, F.size(items) - slot))


def _unit_normals(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Of the cells between two neighbouring lines of nodes: products of their diagonals; NaN for a cell without area."""
    n = np.cross(upper[1:, 2:] - lower[:-1, 2:], upper[:-1, 2:] - lower[1:, 2:])
    size = np.linalg.norm(n, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size > 1e-6, n / size, np.nan)


def _fit(m: np.ndarray, hits: np.ndarray, least: float, most: float, tortuosity: float, normal_dot: float) -> tuple[float, float, int] | None:
    """(longest leg, all legs, slot) of a candidate that crosses at ``hits`` (nodes) beside the lines of ``m`` (lines, nodes), if it fits.

    A node is own (along the line or candidate), on (along the track that crosses it), z, y, x.
    """
    n, on = len(m), hits[:, 1]
    if n > 1:
        # On each crossing track, does it run up with the lines' order?
        up = m[-1, :, 1] > m[0, :, 1]
    else:
        # One line: the first crossing track says on which side the candidate lies, and the others follow.
        up = (on > m[0, :, 1]) == (on[0] > m[0, 0, 1])
        up[0] = True
    before = np.where(up, m[:, :, 1] < on, m[:, :, 1] > on).sum(axis=0)
    slot = int(before[0])
    if (before != slot).any():
        return None
    along, beside = np.diff(hits, axis=0), [m[k] - hits for k in (slot - 1, slot) if 0 <= k < n]
    arcs = [np.abs(along[:, 0]), *[np.abs(d[:, 1]) for d in beside]]
    chords = np.concatenate([np.linalg.norm(along[:, 2:], axis=1), *[np.linalg.norm(d[:, 2:], axis=1) for d in beside]])
    if (arcs[0] > most).any() or slot in (0, n) and (np.concatenate(arcs[1:]) > most).any():
        return None
    legs = np.concatenate(arcs)
    if (legs < least).any() or (legs > tortuosity * chords).any() or not ((along[:, 0] > 0).all() or (along[:, 0] < 0).all()):
        return None
    # Cells beside the candidate must not fold over against each other, nor against those beyond.
    lines = [m[k] if k < slot else hits if k == slot else m[k - 1] for k in range(max(0, slot - 2), min(n, slot + 2) + 1)]
    strips = [_unit_normals(a, b) for a, b in itertools.pairwise(lines)]
    at = slot - max(0, slot - 2)
    agree = lambda a, b: ((a * b).sum(axis=1) >= normal_dot).all()
    for k in (at - 1, at):
        if 0 <= k < len(strips) and (np.isnan(strips[k]).any() or not agree(strips[k][:-1], strips[k][1:])):
            return None
    if not all(agree(a, b) for a, b in itertools.pairwise(strips)):
        return None
    return float(legs.max()), float(legs.sum()), slot


def _judged(c: DataFrame, *rules: float) -> DataFrame:
    """grid, kind, track, slot, widest, total: the candidates (with m, the lines beside them, and hits) that fit. Some small arrays a row."""

    def nodes(a: pa.Array) -> np.ndarray:
        return np.stack([a.field(k).to_numpy() for k in _NODE], axis=1)

    def run(batches):
        for b in batches:
            hits, lines = b.column("hits"), b.column("m")
            own, beside = nodes(hits.flatten()), nodes(lines.flatten().flatten())
            q, n = hits.value_lengths().to_numpy(), lines.value_lengths().to_numpy()
            at, start = np.cumsum(q) - q, np.cumsum(n * q) - n * q
            fits = [_fit(beside[s : s + k * w].reshape(k, w, -1), own[o : o + w], *rules) for o, w, s, k in zip(at.tolist(), q.tolist(), start.tolist(), n.tolist(), strict=True)]
            take = [i for i, f in enumerate(fits) if f]
            found = pa.Table.from_batches([b]).select(["grid", "kind", "track"]).take(pa.array(take, pa.int64()))
            widest, total, slot = (pa.array([fits[i][k] for i in take], kind) for k, kind in enumerate((pa.float64(), pa.float64(), pa.int32())))
            yield from found.append_column("slot", slot).append_column("widest", widest).append_column("total", total).to_batches()

    kinds = dict(c.dtypes)
    return c.select("grid", "kind", "track", "hits", "m").mapInArrow(run, f"grid {kinds['grid']}, kind int, track {kinds['track']}, slot int, widest double, total double")


def _claimed(grids: DataFrame) -> DataFrame:
    """lo, hi, owner: the crossings that grids have."""
    pairs = F.explode(F.flatten(F.transform("rows", lambda r: F.transform("cols", lambda c: F.struct(F.least(r, c).alias("lo"), F.greatest(r, c).alias("hi"))))))
    return grids.select(F.col("grid").alias("owner"), pairs.alias("p")).select("p.lo", "p.hi", "owner")


def grown_grids(edges: DataFrame, tracks: DataFrame, seeds: DataFrame, least: float, most: float, tortuosity: float = 1.35, normal_dot: float = 0.0, exclusive: bool = False, rounds: int | None = None) -> DataFrame:
    """grid, rows, cols, nodes: for each seed (grid, anchor) the grid that grew from it; seeds without a first crossing have none.

    ``edges`` (a, b, pos_a, pos_b, z, y, x) are crossings with places along both tracks, ``tracks`` (track, family, length)
    have two families. A seed's first crossing is with the longest track that it crosses ``least`` or more from all four ends
    (then the one with most clearance, then the least). Then, in rounds, each grid takes one row or column. A track may
    be taken that crosses all tracks of the other kind,

    * lies in the same place among the lines of its own kind on all of them, and meets them in their order,
    * adds legs (pieces of track between neighbouring nodes) of ``least`` or more, and of ``most`` or less but between
      two lines that were neighbours, none longer than ``tortuosity`` times its chord,
    * and adds cells with an area whose normals agree with those of neighbouring cells (a dot product of ``normal_dot`` or more).

    Of these, the one whose longest leg is shortest is taken; ties go to the least sum of legs, rows, and the least track.
    With ``exclusive`` a crossing belongs to one grid: of grids that want it in a round, that of the better candidate (then
    the least grid) has it, and the others choose again without it. Grids grow until none can, or for ``rounds`` rounds;
    the result has no order to depend on. nodes[i][j] are the places of row i and column j: own (along the row), on (along
    the column), z, y, x.
    """
    tables = Tables(edges.sparkSession, "growth")
    both = tables.put(best_crossings_both_ways(edges, tracks), "crossings")
    length = tracks.select(F.col("track").alias("dst"), F.col("length").alias("l"))
    first = seeds.select("grid", F.col("anchor").alias("src")).join(both.where(F.col("clearance") >= least), "src").join(length, "dst")
    first = first.groupBy("grid").agg(F.min_by(F.struct("src", "dst", *_NODE), F.struct(-F.col("l"), -F.col("clearance"), "dst")).alias("b")).select("grid", "b.*")
    if exclusive:
        # Of seeds with one first crossing, the least grid has it.
        first = first.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.min_by(F.struct("grid", "src", "dst", *_NODE), "grid").alias("b")).select("b.*")
    first = tables.put(first, "first")
    grids = first.select("grid", F.array("dst").alias("rows"), F.array("src").alias("cols"), F.array(F.array(_node())).alias("by_row"), F.array(F.array(_node("on", "own"))).alias("by_col"))
    start = lambda kind, own, other: first.select("grid", F.lit(kind).alias("kind"), F.col(own).alias("src"), F.col(other).alias("__not")).join(both, "src").where("dst != __not").select("grid", "kind", F.col("dst").alias("track"), F.array(_node()).alias("hits"))
    # Kind 0: rows, which cross the columns; 1: columns.
    grids, cands, done = tables.put(grids, "grids"), tables.put(start(0, "src", "dst").unionByName(start(1, "dst", "src")), "cands"), []
    taken = _claimed(grids) if exclusive else None
    if exclusive:
        cands = tables.put(_unclaimed(cands, grids, taken), "cands-free")
    for round_ in itertools.count() if rounds is None else range(rounds):
        c = cands.join(grids.select("grid", F.array("by_row", "by_col").alias("lines")), "grid").withColumn("m", F.get("lines", F.col("kind"))).drop("lines")
        fit = _judged(c, least, most, tortuosity, normal_dot)
        best = fit.groupBy("grid").agg(F.min(F.struct("widest", "total", "kind", "track", "slot")).alias("b"))
        best = tables.put(best.select("grid", "b.*"), f"best-{round_}")
        if best.isEmpty():
            break
        done.append(grids.join(best.select("grid"), "grid", "left_anti"))
        grids = grids.join(best.select("grid"), "grid", "left_semi")
        cands = cands.join(best.select("grid"), "grid", "left_semi")
        took = best
        if exclusive:
            across = grids.select("grid", F.array("cols", "rows").alias("others"))
            want = best.join(across, "grid").withColumn("other", F.explode(F.get("others", F.col("kind")))).select("grid", "widest", "total", F.least("track", "other").alias("lo"), F.greatest("track", "other").alias("hi"))
            lost = want.join(want.groupBy("lo", "hi").agg(F.min(F.struct("widest", "total", "grid")).alias("w")), ["lo", "hi"]).where("w.grid != grid").select("grid").distinct()
            took = tables.put(best.join(lost, "grid", "left_anti"), f"took-{round_}")
        chosen = took.select("grid", "kind", "track", "slot").join(cands, ["grid", "kind", "track"])
        grids = tables.put(_extended(grids, chosen), f"grids-{round_}")
        t = took.select("grid", F.col("kind").alias("k"), F.col("track").alias("t"), "slot")
        rest = cands.join(t, "grid", "left").where("k is null or k != kind or t != track")
        same = rest.where("k is null or k = kind").select(*cands.columns)
        met = rest.where("k != kind").join(both.select(F.col("src").alias("t"), F.col("dst").alias("track"), _node().alias("node")), ["t", "track"])
        cands = same.unionByName(met.select("grid", "kind", "track", _with(F.col("hits"), F.col("slot"), F.col("node")).alias("hits")))
        if exclusive:
            taken = tables.put(taken.unionByName(_claimed(grids)).distinct(), f"taken-{round_}")
            cands = _unclaimed(cands, grids, taken)
        cands = tables.put(cands, f"cands-{round_}")
        tables.drop(f"cands-{round_ - 1}")
    every = reduce(DataFrame.unionByName, [*done, grids])
    return every.select("grid", "rows", "cols", F.col("by_row").alias("nodes"))


def _extended(grids: DataFrame, chosen: DataFrame) -> DataFrame:
    """The grids with their chosen row or column; grids without a choice as they are."""
    g = grids.join(chosen, "grid", "left")
    slot, hits, track = F.col("slot"), F.col("hits"), F.col("track")
    row, col = F.coalesce(F.col("kind") == 0, F.lit(False)), F.coalesce(F.col("kind") == 1, F.lit(False))
    own = lambda on, items, item: F.when(on, _with(F.col(items), slot, item)).otherwise(F.col(items))
    crossed = lambda lines: F.zip_with(lines, hits, lambda line, h: _with(line, slot, _flipped(h)))
    by_row = F.when(row, _with(F.col("by_row"), slot, hits)).when(col, crossed(F.col("by_row"))).otherwise(F.col("by_row"))
    by_col = F.when(col, _with(F.col("by_col"), slot, hits)).when(row, crossed(F.col("by_col"))).otherwise(F.col("by_col"))
    return g.select("grid", own(row, "rows", track).alias("rows"), own(col, "cols", track).alias("cols"), by_row.alias("by_row"), by_col.alias("by_col"))


def _unclaimed(cands: DataFrame, grids: DataFrame, taken: DataFrame) -> DataFrame:
    """Candidates none of whose crossings is another grid's."""
    across = grids.select("grid", F.array("cols", "rows").alias("others"))
    want = cands.select("grid", "kind", "track").join(across, "grid").withColumn("other", F.explode(F.get("others", F.col("kind"))))
    want = want.withColumn("lo", F.least("track", "other")).withColumn("hi", F.greatest("track", "other"))
    barred = want.join(taken, ["lo", "hi"]).where("owner != grid").select("grid", "kind", "track").distinct()
    return cands.join(barred, ["grid", "kind", "track"], "left_anti")
